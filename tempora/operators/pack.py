"""Sequences packed into bins of bounded length."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import with_row_index


def best_fit(lengths: list[int], limit: int) -> list[int]:
    """A bin for each length by best-fit decreasing; what is longer than the limit gets its own."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room: list[tuple[int, int]] = []
    out, n = [0] * len(lengths), 0
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, n = max(limit, lengths[i]), n, n + 1
        out[i] = b
        insort(room, (left - lengths[i], b))
    return out


def pack_sequences(df: DataFrame, *, limit: int = 4096, block: int = 256, id_: str = "idx", length: str = "length") -> DataFrame:
    """id, length, block, bin: the rows of each block of ``block`` rows, by id, in bins of at most
    ``limit`` tokens. Blocks are independent, so a task never holds more than one."""
    at = with_row_index(df.select(id_, length), [id_]).withColumn("block", F.floor(F.col("row_idx") / block).cast("long"))
    kind = df.schema[id_].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_idx")
        return frame.assign(bin=best_fit([int(x) for x in frame[length]], limit))[[id_, length, "block", "bin"]]

    return at.groupBy("block").applyInPandas(pack, f"{id_} {kind}, {length} long, block long, bin long")


def concat_packed(df: DataFrame, *, order: str = "idx") -> DataFrame:
    """One row a bin: input_ids, labels and loss_scale of its rows in order, and position_ids that
    start again with each."""
    parts = F.array_sort(F.collect_list(F.struct(order, "input_ids", "labels", "loss_scale")))
    g = df.groupBy("block", "bin").agg(parts.alias("p"))
    position = F.flatten(F.transform("p.input_ids", lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))))
    return g.select("block", "bin", *[F.flatten(f"p.{c}").alias(c) for c in ("input_ids", "labels", "loss_scale")], position.alias("position_ids"))
