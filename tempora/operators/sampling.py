"""Row order, samples, splits, mixes and batches of whole datasets.

Places in a global order come from ranges of values (``places``), never from one task that sees all
rows. Random orders are by md5 of a seed and the id, which any engine repeats.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import prefix_sums, with_row_index


def shuffled_key(id_: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def index_range(df: DataFrame, order: Sequence[Column | str], start: int = 0, end: int = -1) -> DataFrame:
    """Rows from place ``start`` to ``end`` (inclusive; -1 is open). Without bounds all rows."""
    if start <= 0 and end < 0:
        return df
    at = with_row_index(df, order)
    hit = (F.col("row_idx") >= start) & ((F.col("row_idx") <= end) if end >= 0 else F.lit(True))
    return at.where(hit).drop("row_idx")


def shard_range(df: DataFrame, order: Sequence[Column | str], k: int, m: int) -> DataFrame:
    """The k-th of m equal shards; the remainder of the rows is in none."""
    at = with_row_index(df, order)
    each = df.count() // m
    return at.where((F.col("row_idx") >= k * each) & (F.col("row_idx") < (k + 1) * each)).drop("row_idx")


def natural_id_order(col: str) -> list[Column]:
    """Numeric ids by value, then the others as text."""
    number = F.col(col).try_cast("bigint")
    return [number.isNull(), number, F.col(col)]


def head_by_id(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.orderBy(*natural_id_order(col)).limit(n)


def concat_datasets(first: DataFrame, *others: DataFrame) -> DataFrame:
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def distinct_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` for each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def sample_count(df: DataFrame, n: int, *, id_: str = "id", seed: int = 42, shuffle: bool = True) -> DataFrame:
    """``n`` rows: without replacement up to the size of ``df``, else whole copies and a sample for the
    rest. Adds copy. Unshuffled, the sample is the head."""
    total = df.count()
    if not total:
        return df.withColumn("copy", F.lit(0))
    order = [shuffled_key(id_, seed), F.col(id_)] if shuffle else [F.col(id_)]
    part = index_range(df, order, 0, (n % total if n >= total else n) - 1).withColumn("copy", F.lit(n // total)) if n % total else df.limit(0).withColumn("copy", F.lit(0))
    whole = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n // total - 1)))) if n >= total else None
    return part if whole is None else whole.unionByName(part)


def sample_percent(df: DataFrame, percent: int, **how) -> DataFrame:
    return sample_count(df, df.count() * percent // 100, **how)


def bottom_k(df: DataFrame, k: int, *, id_: str = "id", seed: int = 42) -> DataFrame:
    """A uniform sample of exactly ``k`` rows (all, if there are no more): those whose md5 of id and seed is
    least. Tasks pass on what is under a bound that k rows and a few are expected to meet; if chance had it
    that fewer did, the bound is doubled. So about k rows are shuffled, however many there are."""
    n, key = df.count(), shuffled_key(id_, seed)
    if n <= k:
        return df
    share = (k + 6 * math.sqrt(k) + 20) / n
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2**32
    while df.where(place < share).count() < k:
        share *= 2
    return df.where(place < share).orderBy(key, id_).limit(k)


def train_val_split(df: DataFrame, ratio: float, *, id_: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Disjoint parts that make the whole: a row is in the second if its hash is under the ratio."""
    low = F.conv(F.substring(shuffled_key(id_, seed), 1, 8), 16, 10).cast("double") < ratio * 2**32
    marked = df.withColumn("_val", low)
    return marked.where("not _val").drop("_val"), marked.where("_val").drop("_val")


def interleave(dfs: list[DataFrame], probs: list[float], order: list[str], *, seed: int = 42, stop: str = "first_exhausted", block: int = 65_536) -> DataFrame:
    """Datasets mixed by probability: output slot i draws its source by md5 of the seed and i and takes
    that source's next row. Stops where the first source ends, or once all have ended (a source that
    ended is taken round again). Empty sources end at once.

    Draws are counted by blocks of slots, further blocks only until the end is known; each block
    numbers its own slots after the draws of the blocks before, so slots meet no global sort.
    """
    spark, first = dfs[0].sparkSession, stop == "first_exhausted"
    sizes = [d.count() for d in dfs]
    edges = [sum(probs[: i + 1]) for i in range(len(probs))]
    needed = [s + 1 if first else s for s in sizes]  # draws of a source that settle its end
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    source = F.coalesce(*[F.when(draw < e, i) for i, e in enumerate(edges[:-1])], F.lit(len(dfs) - 1))

    def slots(start: int, end: int) -> DataFrame:
        return spark.range(start, end).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / block).alias("_b"))

    drawn, known, end = [0] * len(dfs), slots(0, 0).groupBy("_b", "source").agg(F.count("*").alias("_n")), 0
    while not (any if first else all)(d >= n for d, n in zip(drawn, needed, strict=True)):
        short = [(n - d) / p for d, n, p in zip(drawn, needed, probs, strict=True) if d < n and p > 0]
        if not first and len(short) < sum(d < n for d, n in zip(drawn, needed, strict=True)):
            raise ValueError("a source that is never drawn can't end")
        more = max(1, int((min if first else max)(short) * 1.02 / block) + 1) * block
        counts = slots(end, end + more).groupBy("_b", "source").agg(F.count("*").alias("_n"))
        known, end = known.unionByName(counts), end + more
        for r in counts.groupBy("source").agg(F.sum("_n").alias("n")).collect():  # a row a source
            drawn[r["source"]] += r["n"]
    grid = spark.range(end // block).select(F.col("id").alias("_b"), F.explode(F.array(*map(F.lit, range(len(dfs))))).alias("source"))
    counted = grid.join(known, ["_b", "source"], "left").select("_b", "source", F.coalesce("_n", F.lit(0)).alias("_n"), (F.col("source") * (end // block) + F.col("_b")).alias("_i"))
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("source") + 1)
    total = F.element_at(F.array(*map(F.lit, [sum(drawn[:i]) for i in range(len(dfs))])), F.col("source") + 1)
    before = prefix_sums(counted, "_i", "_n", "_upto").select("_b", "source", (F.col("_upto") - F.col("_n") - total).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b", "source").orderBy("slot")) - 1
    ranked = slots(0, end).withColumn("_in", inside).join(before, ["_b", "source"]).withColumn("k", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")
    # the slots that draw a source's last row, or one beyond it
    ends = [r["slot"] for r in ranked.where(F.col("k") == size - (0 if first else 1)).select("slot").collect()]
    last = min(ends, default=0) if first else max(ends, default=-1) + 1
    rows = None
    for i, (d, o) in enumerate(zip(dfs, order, strict=True)):
        at = with_row_index(d, [o], "_at").withColumn("source", F.lit(i))
        rows = at if rows is None else rows.unionByName(at, allowMissingColumns=True)
    taken = ranked.where((F.col("slot") < last) & (size > 0)).withColumn("_at", F.try_mod("k", size.cast("bigint"))).drop("k")
    return taken.join(rows, ["source", "_at"]).drop("_at")


def circular_shift_negatives(df: DataFrame, batch: int, order: Sequence[Column | str], value: str) -> DataFrame:
    """Adds negative: the previous row's value in its batch of ``batch`` rows, the last's for the first."""
    at = with_row_index(df, order)
    by = Window.partitionBy("_b").orderBy("row_idx")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = at.withColumn("_b", F.floor(F.col("row_idx") / batch))
    return out.withColumn("negative", F.coalesce(F.lag(value).over(by), F.last_value(value).over(whole))).drop("_b")


def assign_batches(df: DataFrame, order: Sequence[Column | str], n: int, how: str = "contiguous") -> DataFrame:
    """Adds worker: ``contiguous`` shards with bounds floor(k * rows / n), ``strided`` or ``round_robin``."""
    at = with_row_index(df, order)
    if how != "contiguous":
        return at.withColumn("worker", (F.col("row_idx") % n).cast("int"))
    total = at.count()
    bounds = [k * total // n for k in range(1, n)]
    return at.withColumn("worker", sum(((F.col("row_idx") >= b).cast("int") for b in bounds), F.lit(0)).cast("int"))


def length_grouped_batches(df: DataFrame, batch: int, workers: int, *, id_: str = "idx", length: str = "length", seed: int = 42, mega: int = 50) -> DataFrame:
    """Adds batch and worker: rows in a seeded order fall into mega-batches, are sorted by length inside
    each, cut into batches and dealt to the workers in turn."""
    at = with_row_index(df, [shuffled_key(id_, seed), F.col(id_)])
    out = at.withColumn("_m", F.floor(F.col("row_idx") / (batch * mega)))
    rank = F.row_number().over(Window.partitionBy("_m").orderBy(F.desc(length), F.col("row_idx"))) - 1
    out = out.withColumn("batch", (F.col("_m") * mega + F.floor(rank / batch)).cast("long"))
    return out.withColumn("worker", (F.col("batch") % workers).cast("int")).drop("_m", "row_idx")
