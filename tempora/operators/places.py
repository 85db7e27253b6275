"""Places and running sums of rows in a global order, without a task that sees all rows.

Rows are filed by value: splitters from a bounded sample cut the order into ranges, the ranges are
counted, and a row's place is what lies before its range plus its place inside. The splitters only
decide how even the ranges are; places follow from the values alone, whatever the partitions are and
however often an executor has to read its rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField, StructType

#: Rows that a range should hold, and the most ranges there are (their splitters and counts are
#: constants of the plan). Beyond the product the ranges get larger, and their sorts spill.
RANGE_ROWS, MOST_RANGES = 1_000_000, 16_384
#: Sampled keys for each range.
OVERSAMPLE = 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` names it more than once."""
    return F.transform(F.array(value), body)[0]


def constant_longs(values: Sequence[int]) -> Column:
    """An array constant, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def filed(df: DataFrame, order: Sequence[Column | str], ranges: int | None = None) -> tuple[DataFrame, list[str], list[int]]:
    """``df`` with its order columns as ``_o0`` ... and ``_range``; their names; rows before each range."""
    plain = [F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + [F.xxhash64(*plain)]
    names = [f"_o{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(c) for k, c in zip(keys, names, strict=True)])
    only = keyed.select(F.struct(*names).alias("k"))
    n = only.count()
    few = min(n // 10_000 + 1, df.sparkSession.sparkContext.defaultParallelism)
    ranges = min(ranges or max(n // RANGE_ROWS + 1, few), MOST_RANGES)
    splitters = None
    if ranges > 1:
        sample = only.sample(min(1.0, OVERSAMPLE * ranges / n), seed=7).agg(F.sort_array(F.collect_list("k")).alias("k"))
        size, at = F.size("k"), F.sequence(F.lit(1), F.lit(ranges - 1))
        cuts = F.transform(at, lambda i: F.get("k", F.floor(i * size / ranges).cast("int")))
        text = sample.select(F.to_json(F.filter(cuts, lambda x: x.isNotNull()))).first()[0]
        kind = StructType([StructField(c, keyed.schema[c].dataType) for c in names]).simpleString()
        splitters = F.sort_array(F.from_json(F.lit(text), f"array<{kind}>"))
    if splitters is None:
        return keyed.withColumn("_range", F.lit(0)), names, [0]
    steps = F.array(*[F.lit(1 << b) for b in range(ranges.bit_length() - 1, -1, -1)])
    place = let(F.struct(*names), lambda key: F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(splitters, i + s - 1) <= key, i + s).otherwise(i)))
    out = keyed.withColumn("_range", place)
    counts = dict(out.groupBy("_range").count().collect())  # a row a range
    before = [0] * (ranges + 1)
    for i in range(ranges):
        before[i + 1] = before[i] + counts.get(i, 0)
    return out, names, before


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_idx", ranges: int | None = None) -> DataFrame:
    """``df`` plus its place (from 0) in the ascending order of columns, nulls first. Rows that tie have
    places by a hash of the row, so that only equal rows may change theirs.

    ``df`` is read four times, for all but the last its order columns only, and must give the same
    rows each time: a table, or what follows from one (``sources.shared.stored`` writes what costs more).
    """
    out, names, before = filed(df, order, ranges)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*names))
    return out.withColumn(name, F.get(constant_longs(before), F.col("_range")) + inside - 1).drop("_range", *names)


def _before(sums: DataFrame, most: int, step: int) -> DataFrame:
    """``_block, _before`` of ``sums`` (_block from 0 to ``most``, _s): the sum of all earlier blocks, by a tree of
    block sums with as many levels as the number of blocks needs."""
    inside = F.sum("_s").over(Window.partitionBy("_p").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_s")
    out = sums.withColumn("_p", F.floor(F.col("_block") / step)).withColumn("_in", inside)
    if most < step:
        return out.select("_block", F.col("_in").alias("_before"))
    above = sums.groupBy(F.floor(F.col("_block") / step).alias("_block")).agg(F.sum("_s").alias("_s"))
    up = _before(above, most // step, step).select(F.col("_block").alias("_p"), F.col("_before").alias("_up"))
    return out.join(up, "_p").select("_block", (F.col("_in") + F.col("_up")).alias("_before"))


def prefix_sums(df: DataFrame, index: str, value: str, name: str, step: int = 4096) -> DataFrame:
    """Sums of ``value`` up to each row in the order of ``index`` (long, from 0): sums inside blocks of
    ``step`` places plus what lies before them. No task holds more than ``step`` places or block sums."""
    most = df.agg(F.max(index)).first()[0] or 0
    out = df.withColumn("_block", F.floor(F.col(index) / step))
    blocks = _before(out.groupBy("_block").agg(F.sum(value).alias("_s")), most // step, step)
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("_inside", inside).join(blocks, "_block").withColumn(name, F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before")
