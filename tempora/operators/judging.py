"""Judge scores joined into verified annotations and lists to rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("visual_grounding", "causal_logic", "viewer_centricity", "temporal_consistency", "answer_consistency")
PASS = 3.5


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by ``order``; rows with a null key go.

    ``max_by`` over the row combines before the shuffle, so a key with many rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    best = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def judge_scores(judgements: DataFrame, *, threshold: float = PASS) -> tuple[DataFrame, DataFrame]:
    """Segments with the mean of the five dimensions (what is no number counts 0); a judge's own
    average_score wins unless missing or 0. Videos with the mean over segments; they pass if all do."""
    dims = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in DIMENSIONS]
    own = F.nullif(F.col("average_score").try_cast("double"), F.lit(0.0))
    seg = judgements.withColumn("score", F.coalesce(own, sum(dims[1:], dims[0]) / len(dims)))
    seg = seg.withColumn("segment_passed", F.col("score") >= threshold)
    video = seg.groupBy("judge", "video_id").agg(F.avg("score").alias("average_score"), F.bool_and("segment_passed").alias("passed"), F.count("*").alias("n_segments"))
    return seg, video


def committee_join(segments: DataFrame, judge_a: DataFrame, judge_b: DataFrame, *, threshold: float = PASS) -> DataFrame:
    """Segments (video_id, segment_index) with the mean of the judges that saw them: committee_score
    (0 if none did), n_judges, passed, and the suggestions of both."""
    key = ["video_id", "segment_index"]
    out = segments
    for side, judge in (("a", judge_a), ("b", judge_b)):
        has = [F.col("score").alias(f"_{side}")] + ([F.col("rewrite_suggestion").alias(f"_s{side}")] if "rewrite_suggestion" in judge.columns else [F.lit(None).cast("string").alias(f"_s{side}")])
        out = out.join(judge.select(*key, *has), key, "left")
    n = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    total = F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))
    out = out.withColumns({"n_judges": n, "committee_score": F.when(n > 0, total / n).otherwise(0.0), "suggestions": F.concat_ws(" ", F.nullif("_sa", F.lit("")), F.nullif("_sb", F.lit("")))})
    return out.withColumn("passed", (F.col("n_judges") > 0) & (F.col("committee_score") >= threshold)).drop("_a", "_b", "_sa", "_sb")


def committee_video(scored: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos with the mean of their segments' scores (0 without segments), the failed indices and
    whether none failed; and the list of segments to rewrite."""
    v = scored.groupBy("video_id").agg(
        F.avg("committee_score").alias("committee_score"), F.count("*").alias("n_segments"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("segment_index")))).alias("failed"),
    )
    out = videos.select("video_id").join(v, "video_id", "left")
    failed = F.coalesce("failed", F.array().cast("array<int>"))
    out = out.select(
        "video_id", F.coalesce("committee_score", F.lit(0.0)).alias("committee_score"), F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"),
        failed.alias("failed_indices"), (F.size(failed) == 0).alias("committee_passed"),
    )
    return out, scored.where("not passed").select("video_id", "segment_index", "committee_score", "suggestions")


def reuse_cached_choices(rows: DataFrame, cache: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, …) split into those whose cached choices are exactly ``n``, with the choices, and
    those that need generation. ``cache`` has id, choice and pos."""
    sets = cache.groupBy("id").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("pos", "choice"))).alias("_c"))
    joined = rows.join(sets.where(F.col("_n") == n).select("id", F.col("_c.choice").alias("choices")), "id", "left")
    return joined.where("choices is not null"), joined.where("choices is null").drop("choices")


def pending_only(df: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows whose key isn't among the finished ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")

