"""Mixing sources to target weights by drawing fixed-length blocks.

The words of each source are laid out in a fixed pseudorandom order of its documents and packed into
blocks of ``block`` words (of a small source shorter ones, so that it has 64 at least). Each output shard draws multinomial counts of the sources; the slots of a
source map through pseudorandom permutations of its block indices, one permutation a pass; and the
blocks join the slots by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Words of a block, blocks of an output shard, and times that a mix may take a document.
BLOCK, SHARD, REPEATS = 128, 4096, 3
#: Blocks that a source has at least, if it has as many words; what it gives is exact to about a block.
LEAST_BLOCKS = 64
#: Copies of a row that one task lays out at most.
CHUNK = 10_000
#: Weights of the sources in the order of their names, again and again.
WEIGHTS = (1, 2, 3)
#: Sources whose block counts are broadcast at most (24 bytes each); more are refused, none dropped.
MAX_SOURCES = 1_000_000
#: Rows of a bucket of the layout, about.
BUCKET_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size to source, source_size, i (its place by code point, null last), weight, target.

    The weights share the total of all sizes; a target stops at ``REPEATS`` times its source's size
    and the excess is shared again by weight among the rest until none is above. Each round is an
    aggregate over the sources; the driver sees sums only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    s = sizes.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    s = materialize(s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("i") % len(WEIGHTS) + 1).cast("int"))), "sources")
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, n = total / max(1, weights), 0
    while total:
        full = F.col("source_size") * REPEATS <= F.lit(level) * F.col("weight")
        got = s.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * REPEATS)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if got["n"] == n or not got["open"]:
            break
        n, level = got["n"], (total - got["given"]) / got["open"]
    return s.withColumn("target", F.least(F.col("source_size") * float(REPEATS), F.lit(float(level)) * F.col("weight")))


def _permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 to size - 1, by a four-round Feistel network that walks out-of-range
    values on until they fall in range."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = left << h | right
        todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


@dataclass
class Quotas:
    """Per source: words, blocks, and the slots that the mix gives it."""

    blocks: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, source_size: np.ndarray, target: np.ndarray, block: np.ndarray) -> Quotas:
        blocks = -(-source_size // block)
        per = source_size / np.maximum(blocks, 1)  # words of a slot, on the average
        return cls(blocks, np.minimum(np.rint(target / np.maximum(per, 1e-9)).astype(np.int64), REPEATS * blocks) * (blocks > 0))


def _draws(shared, shard: int, total: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share = shared.value.slots / max(1, total)
        for frame in frames:
            for i in frame["id"]:
                n = min(shard, total - i * shard)
                counts = np.random.default_rng([seed, i]).multinomial(n, share / share.sum())
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": i, "i": at, "n": counts[at]})

    return run


def _slots(shared, totals, seed: int):
    """Each draw's slots with the block that they take. Slots drawn beyond a source's quota go to the
    sources that were drawn too seldom, in order."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quota, drawn = shared.value, totals.value
        over, under = np.maximum(drawn - quota.slots, 0), np.maximum(quota.slots - drawn, 0)
        over_at, under_to = np.cumsum(over) - over, np.cumsum(under)
        for frame in frames:
            for a in range(0, len(frame), 256):
                f = frame.iloc[a : a + 256]
                n = f["n"].to_numpy()
                i = np.repeat(f["i"].to_numpy(), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = np.repeat(f["first"].to_numpy(), n) + place
                extra = k >= quota.slots[i]
                spare = over_at[i] + k - quota.slots[i]
                j = np.searchsorted(under_to, spare[extra], "right")
                k[extra] = drawn[j] + spare[extra] - (under_to[j] - under[j])
                i[extra] = j
                turn, index = np.divmod(k, quota.blocks[i])
                key = (i * 1_000_003 + turn * 7919 + seed).astype(np.uint64)
                yield pd.DataFrame({"shard": np.repeat(f["shard"].to_numpy(), n), "slot": np.repeat(f["slot"].to_numpy(), n) + place, "i": i, "block": _permuted(index, quota.blocks[i], key)})

    return run


@dataclass
class Mix:
    """``laid``: a row for each row of the input, with d (doc_id), h (hash of the text), i (source), b
    (words of its blocks), size, at (its first word in the source). ``sources``: source, i, source_size,
    weight, target, b. ``slots``: shard, slot, i, block. ``repeats``: are there rows of one id and text?"""

    laid: DataFrame
    sources: DataFrame
    slots: DataFrame
    repeats: bool

    def pieces(self, laid: DataFrame) -> DataFrame:
        """``laid`` with a row for each block that a document is part of: block, from (its first word
        there, counted in the document) and words."""
        each = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr("at div b"), F.expr("(at + size - 1) div b"))))
        start = F.greatest(F.col("at"), F.col("block") * F.col("b"))
        end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("b"))
        return each.withColumns({"from": start - F.col("at"), "words": end - start})

    def taken(self) -> DataFrame:
        """doc_id, i, size, taken (words that the mix takes, repeats counted) for each row of the input."""
        times = self.slots.groupBy("i", "block").agg(F.count("*").alias("times"))
        got = self.pieces(self.laid.select("i", "b", "at", "size")).join(times, ["i", "block"])
        got = got.groupBy("i", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        out = self.laid.withColumn("at", F.when(F.col("size") > 0, F.col("at"))).join(got, ["i", "at"], "left")
        return out.select(F.col("d").alias("doc_id"), "i", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mix itself: shard, slot, at (orders the pieces of a block), source, doc_id, words, text.

        ``docs`` is the input of the plan. Texts are cut in their own rows and meet the slots by the
        index of the block; no task holds more than a document's text at once.
        """
        own = docs.select(F.col("doc_id").cast("long").alias("own_d"), F.xxhash64("text").alias("own_h"), "text").where("text is not null")
        own = own.dropDuplicates(["own_d", "own_h"]) if self.repeats else own
        laid = self.laid.where("size > 0").join(own, F.col("d").eqNullSafe(F.col("own_d")) & (F.col("h") == F.col("own_h")))
        cut = self.pieces(laid.withColumn("tokens", F.expr(r"regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)")).drop("text"))
        text = F.array_join(F.slice("tokens", (F.col("from") + 1).cast("int"), F.col("words").cast("int")), "")
        cut = cut.select("i", "block", "at", F.col("d").alias("doc_id"), "words", text.alias("text"))
        named = self.slots.join(self.sources.select("i", "source"), "i")
        return named.join(cut, ["i", "block"]).select("shard", "slot", "at", "source", "doc_id", "words", "text")


def plan_mix(docs: DataFrame, *, block: int = BLOCK, shard: int = SHARD, seed: int = 7) -> Mix:
    """Plan a mix of all ``docs`` (doc_id, source, text; further columns are ignored).

    Sources in the order of code points, null last, weigh 1, 2, 3, 1, ... Reruns agree: the layout
    is ordered by hashes of the rows and every draw is seeded by its shard. Defined cases: a null or
    blank text has size 0 and is never taken; rows that repeat count each on its own; a null source
    is a source; null doc_ids are taken like others; an empty table gives an empty mix.
    """
    with Scratch() as scratch:
        keys = docs.select(F.col("doc_id").cast("long").alias("d"), "source", F.xxhash64("text").alias("h"), size_of(F.col("text")).alias("size"))
        keys = scratch(keys, "sizes")
        sources = source_targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")))
        own_block = F.least(F.lit(block), F.greatest(F.lit(1), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long")
        sources = materialize(sources.withColumn("b", own_block), "targets")
        # equal rows are counted, and dealt anew by number, so that they fall into all buckets
        rows = scratch(keys.groupBy("d", "source", "h", "size").agg(F.count("*").alias("n")), "rows")
        repeats = not rows.where("n > 1").isEmpty()
        n_buckets = max(1, -(-keys.count() // BUCKET_ROWS))
        each = rows.where("n = 1").withColumn("k", F.lit(1).cast("long"))
        if repeats:
            parts = rows.where("n > 1").withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(CHUNK).cast("long")))).repartition(F.xxhash64("d", "h", "from"))
            each = each.unionByName(parts.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK - 1, F.col("n"))))).drop("from"))
        # the layout: documents fall into buckets by hash; sums of the buckets before, then inside a bucket
        keys = each.join(sources.select(F.col("source").alias("s"), "i", "b"), F.col("source").eqNullSafe(F.col("s"))).drop("source", "s", "n")
        keys = keys.withColumn("r", F.xxhash64("d", "h", "size", "k", F.lit(seed))).withColumn("bucket", F.pmod("r", F.lit(n_buckets)))
        per = keys.groupBy("i", "bucket").agg(F.sum("size").alias("sum"))
        per = per.select("i", "bucket", (F.sum("sum").over(Window.partitionBy("i").orderBy("bucket")) - F.col("sum")).alias("before"))
        inside = Window.partitionBy("i", "bucket").orderBy("r", "d", "h", "size", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        laid = keys.withColumn("upto", F.sum("size").over(inside)).join(per, ["i", "bucket"])
        laid = materialize(laid.select("d", "h", "i", "b", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("at")), "laid")
        return Mix(laid, sources, _drawn(scratch, sources, shard, seed), repeats)


def _drawn(scratch: Scratch, sources: DataFrame, shard: int, seed: int) -> DataFrame:
    spark = sources.sparkSession
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sources.select("source_size", "target", "b").orderBy("i").collect()
    quota = Quotas.of(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], np.int64))
    total = int(quota.slots.sum())
    shared = spark.sparkContext.broadcast(quota)
    draws = spark.range(-(-total // shard)).mapInPandas(_draws(shared, shard, total, seed), "shard long, i long, n long")
    draws = scratch(draws, "draws")
    drawn = np.zeros(len(rows), np.int64)
    for r in draws.groupBy("i").agg(F.sum("n")).collect():  # a row a source
        drawn[r[0]] = r[1]
    by_source = Window.partitionBy("i").orderBy("shard")
    by_shard = Window.partitionBy("shard").orderBy("i")
    placed = draws.withColumns({"first": F.sum("n").over(by_source) - F.col("n"), "slot": F.sum("n").over(by_shard) - F.col("n")})
    totals = spark.sparkContext.broadcast(drawn)
    # written, as the planner takes the slots for as small as the draws and would broadcast them
    return materialize(placed.mapInPandas(_slots(shared, totals, seed), "shard long, slot long, i long, block long"), "slots")
