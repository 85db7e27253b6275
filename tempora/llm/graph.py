"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: A node that more than one link in this many ends at is a hub. There are fewer than twice as many hubs.
HUB = 1000


def _joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``u``. Hubs, whose links would all meet in one task, are known by
    their degree ``d`` and, as they are few, broadcast; the other nodes join by a shuffle."""
    hubs = least.where(F.col("d") * HUB > n).select("u", F.col("m").alias("_m"))
    met = edges.join(F.broadcast(hubs), "u", "left")
    cold = met.where("_m is null").drop("_m").join(least.where(F.col("d") * HUB <= n).select("u", "m"), "u")
    return met.where("_m is not null").withColumnRenamed("_m", "m").unionByName(cold)


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Link the neighbours of each node to the least node of its neighbourhood (itself included).

    ``edges`` has ``u > v`` and ``n`` rows or a few more. The large star moves the greater neighbours, the
    small star the others.
    """
    low = [F.min("v").alias("m"), F.count("*").alias("d")]
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(*low).withColumn("m", F.least("m", "u"))
        out = _joined(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(*low)
        moved = _joined(edges, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``links`` (a long, b long) to ``node, root``: each linked node with the least node it reaches.

    Self-links and nulls are ignored; nodes without a link have no row; an empty table gives none.
    Every round is one written table, so a lost executor repeats one round at most; the last one, which
    the result reads, is ``scratch``'s table ``name``. Only a row count and a checksum reach the driver.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    now = scratch(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    last, turn = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last, turn = mark, turn + 1
        big = scratch(_stars(now, True, mark[0]), f"{name}-large")
        now = scratch(_stars(big, False, mark[0]), f"{name}-{turn}")
        scratch.done(f"{name}-{turn - 1}")
