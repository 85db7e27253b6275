"""Grouped rewards to advantages, filters of groups, and best-of-n preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .judging import last_wins
from .rewards import weighted_reward

EPS, TINY = 1e-4, 1e-8


def _std(x: Column, by: Window | None = None) -> Column:
    """Sample deviation, 0 for one row."""
    s, n = F.stddev_samp(x), F.count(x)
    return F.when((n.over(by) if by is not None else n) > 1, s.over(by) if by is not None else s).otherwise(0.0)


def _with_total(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over all rows, by a one-row broadcast instead of a window in one task."""
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))


def group_advantages(df: DataFrame, weights: dict[str, float], *, estimator: str = "grpo", scale: str = "group", group: str = "prompt_id") -> DataFrame:
    """Adds reward (weighted, missing ones add nothing) and advantage.

    The baseline is the group's mean. ``estimator``: grpo, rloo (leave one out), reinforce_plus_plus
    (scaled by the deviation of advantages); ``scale``: group, batch, none, or gdpo (each reward
    standardised in its group, weighted and summed, then over the batch; a missing reward makes the
    advantage missing there).
    """
    by = Window.partitionBy(group)
    out = df.withColumn("reward", weighted_reward(df, weights))
    if scale == "gdpo":
        parts = [(F.col(c) - F.avg(c).over(by)) / (_std(F.col(c), by) + TINY) * w for c, w in weights.items()]
        out = out.withColumn("_sum", sum(parts[1:], parts[0]))
        out = _with_total(out, _mean=F.avg("_sum"), _dev=_std(F.col("_sum")))
        return out.withColumn("advantage", (F.col("_sum") - F.col("_mean")) / (F.col("_dev") + TINY)).drop("_sum", "_mean", "_dev")
    mean, k = F.avg("reward").over(by), F.count("*").over(by)
    centred = F.col("reward") - mean
    if estimator == "rloo":
        centred = F.when(k > 1, centred * k / (k - 1)).otherwise(centred)
    out = out.withColumn("advantage", centred)
    if scale == "none":
        return out
    base = F.col("advantage") if estimator == "reinforce_plus_plus" else F.col("reward")
    if scale == "batch":
        out = _with_total(out, _dev=_std(base))
        return out.withColumn("advantage", F.col("advantage") / (F.col("_dev") + EPS)).drop("_dev")
    return out.withColumn("advantage", F.col("advantage") / (_std(base, by) + EPS))


def request_advantages(df: DataFrame, weights: dict[str, float], *, estimator: str = "grpo", scale: str = "group", order: str = "pos", strict: bool = False) -> DataFrame:
    """As above with one reward for each request_id, that of its last row, given to all its rows.

    ``consistent`` tells whether a request's rewards agree; ``strict`` raises where they don't.
    """
    rows = df.withColumn("_r", weighted_reward(df, weights))
    spread = rows.groupBy("request_id").agg((F.max("_r") - F.min("_r") <= 1e-6).alias("consistent"))
    last = last_wins(rows.select("request_id", "prompt_id", order, "_r"), ["request_id"], order)
    got = group_advantages(last, {"_r": 1.0}, estimator=estimator, scale=scale).select("request_id", "reward", "advantage")
    out = rows.drop("_r").join(got, "request_id").join(spread, "request_id")
    if strict:
        out = out.where(F.when(F.col("consistent"), True).otherwise(F.raise_error(F.concat(F.lit("rewards differ in request "), "request_id")).cast("boolean")))
    return out


def drop_zero_variance_groups(df: DataFrame, weights: dict[str, float], n: int, *, order: tuple[str, ...] = ("prompt_id", "pos")) -> DataFrame:
    """The first ``n`` rows of the groups whose rewards differ; all rows if fewer than ``n`` are left."""
    by = Window.partitionBy("prompt_id")
    rows = df.withColumn("reward", weighted_reward(df, weights)).withColumn("_dev", _std(F.col("reward"), by))
    kept = rows.where("_dev > 0")
    enough = kept.agg((F.count("*") >= n).alias("_enough"))
    first = kept.orderBy(*order).limit(n).crossJoin(F.broadcast(enough)).where("_enough")
    every = rows.crossJoin(F.broadcast(enough)).where("not _enough")
    return first.unionByName(every).drop("_dev", "_enough")


def reward_stats(df: DataFrame, weights: dict[str, float], *, group: str = "prompt_id", scale: str = "group") -> DataFrame:
    """One row: mean and deviation of the rewards (by group, or over all for ``batch``), the share of
    groups without variance, and mean and sample deviation of each reward, missing ones left out."""
    rows = df.withColumn("reward", weighted_reward(df, weights))
    g = rows.groupBy(group).agg(F.avg("reward").alias("m"), F.when(F.count("*") > 1, F.stddev_samp("reward")).otherwise(0.0).alias("d"))
    per = g.agg(F.avg("m").alias("reward"), F.avg("d").alias("reward_std"), F.avg((F.abs("d") <= 1e-8).cast("double")).alias("frac_reward_zero_std"))
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in weights}
    cols = [x for c, v in clean.items() for x in (F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std"))]
    total = rows.agg(F.stddev_samp("reward").alias("_all"), *cols)
    out = per.crossJoin(total)
    if scale == "batch":
        out = out.withColumn("reward_std", F.col("_all"))
    return out.drop("_all")


def best_of_n(df: DataFrame, *, n_best: int = 5, threshold: float | None = 0.0, easy: float | None = None, n_samples: int | None = None) -> DataFrame:
    """query_id, positive, negative pairs of candidates (query_id, idx, choice, orm, prm).

    Scores are min-max normalised in the query (a constant one is min(1, value)); score = prm + 10
    orm. A query without a candidate above ``threshold`` in both goes. Positives are the ``n_best``
    highest, less those at or below the threshold and the worst, which is the negative. With
    ``easy``, queries whose positive scores less one reach ``int(n_samples * easy)`` go. Ties rank
    the later candidate higher.
    """
    by = Window.partitionBy("query_id")

    def normal(c: str) -> Column:
        low, high = F.min(c).over(by), F.max(c).over(by)
        return F.when(low == high, F.least(F.lit(1.0), low)).otherwise((F.col(c) - low) / (high - low + 1e-5))

    # one sort in the query, of the columns that are needed; the worst is the last of it
    ok = F.lit(True) if threshold is None else (F.col("orm") > threshold) & (F.col("prm") > threshold)
    rows = df.where("query_id is not null").withColumns({"_ok": ok, "_o": normal("orm"), "_p": normal("prm"), "_any": F.bool_or(ok).over(by), "_size": F.count("*").over(by)})
    rows = rows.where("_any").select("query_id", "idx", "choice", "_ok", "_o", "_size", (F.col("_p") + 10 * F.col("_o")).alias("score"))
    if easy is not None:
        rows = rows.withColumn("_good", F.count_if(F.col("_o") > 0).over(by)).where(F.col("_good") - 1 < int((n_samples or 0) * easy)).drop("_good")
    down = by.orderBy(F.col("score").desc(), F.col("idx").desc())
    rows = rows.drop("_o").withColumns({"_rank": F.row_number().over(down), "negative": F.last("choice").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    top = rows.where((F.col("_rank") <= n_best) & F.col("_ok") & (F.col("_rank") < F.col("_size")))
    return top.select("query_id", "idx", F.col("choice").alias("positive"), "score", "negative")


def all_choices(df: DataFrame) -> DataFrame:
    """Without a scorer every sampled choice is kept."""
    return df.select("query_id", "idx", F.col("choice").alias("positive"))
