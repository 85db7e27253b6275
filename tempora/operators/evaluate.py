"""Predictions against ground truth: pairs by position, overlap of intervals and equality of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import interval_iou

THRESHOLDS = (0.3, 0.5, 0.7, 0.9)


def common_ids(a: DataFrame, b: DataFrame, key: str = "video_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def match_eval_pairs(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each segment of either side, of the videos that both have: matched by (video_id,
    seg_idx), with iou and emotion_match where both are there.

    A full join of the sides keeps the counts of both in one exchange.
    """
    p = pred.select("video_id", "seg_idx", F.col("start_ds").alias("p_start"), F.col("end_ds").alias("p_end"), F.trim("emotion").alias("p_emotion"))
    g = truth.select("video_id", "seg_idx", F.col("start_ds").alias("g_start"), F.col("end_ds").alias("g_end"), F.trim("emotion").alias("g_emotion"))
    pairs = p.join(g, ["video_id", "seg_idx"], "full")
    both = F.col("p_start").isNotNull() & F.col("g_start").isNotNull()
    iou = F.when(both, interval_iou(F.col("p_start"), F.col("p_end"), F.col("g_start"), F.col("g_end")))
    return pairs.withColumns({"iou": iou, "emotion_match": F.when(both, F.col("p_emotion") == F.col("g_emotion"))})


def eval_per_video(pairs: DataFrame) -> DataFrame:
    """Counts and means of each video that both sides have."""
    n = lambda c: F.count(c)
    out = pairs.groupBy("video_id").agg(
        n("p_start").alias("pred_count"), n("g_start").alias("gt_count"), n("iou").alias("compared"),
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("avg_iou"), F.sum("iou").alias("_iou"),
        F.coalesce(F.avg(F.col("emotion_match").cast("int")), F.lit(0.0)).alias("emotion_accuracy"),
        F.count_if("emotion_match").alias("emotion_correct"),
    )
    out = out.where("pred_count > 0 and gt_count > 0").withColumn("count_match", F.col("pred_count") == F.col("gt_count"))
    return out.select("video_id", "count_match", "pred_count", "gt_count", "compared", "avg_iou", "emotion_accuracy", "emotion_correct", "_iou")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def eval_overall(pairs: DataFrame) -> DataFrame:
    """One row over all videos; means are over segments."""
    v = eval_per_video(pairs)
    s = v.agg(
        F.count("*").alias("total_videos"), F.count_if("count_match").alias("segment_count_match"), F.coalesce(F.sum("compared"), F.lit(0)).alias("total_compared_segments"),
        F.sum("_iou").alias("_iou"), F.coalesce(F.sum("emotion_correct"), F.lit(0)).alias("emotion_correct"),
    )
    return s.select(
        "total_videos", "segment_count_match", _ratio(F.col("segment_count_match"), F.col("total_videos")).alias("segment_count_match_rate"), "total_compared_segments",
        _ratio(F.col("_iou"), F.col("total_compared_segments")).alias("avg_iou"), _ratio(F.col("emotion_correct"), F.col("total_compared_segments")).alias("emotion_accuracy"), "emotion_correct",
    )


def eval_by_iou_threshold(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, n_pairs, emotion_accuracy among pairs of that IoU or more (null if there are none)."""
    both = pairs.where("iou is not null")
    row = both.agg(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("iou") >= t).alias("n_pairs"), F.avg(F.when(F.col("iou") >= t, F.col("emotion_match").cast("int"))).alias("emotion_accuracy")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return row.select(F.inline(F.array(*[f"t{i}" for i in range(len(thresholds))])))
