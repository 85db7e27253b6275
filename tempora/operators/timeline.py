"""Segments of a video's timeline, one row a segment: (video_id, pos, start_ds, end_ds, ...).

All windows and joins share the key video_id, so that one exchange serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import match_emotion
from .places import let


def _by_video(*order: str) -> Window:
    return Window.partitionBy("video_id").orderBy(*order)


def normalize_segments(segments: DataFrame, videos: DataFrame, *, min_ds: int = 1) -> DataFrame:
    """Segments made contiguous over [0, dur_ds], each of ``min_ds`` at least.

    ``segments`` has video_id, pos, start_ds, end_ds and further columns, ``videos`` video_id and
    dur_ds. Rows whose end is not after their start go; a video without valid segments gets one over
    its whole length; a video of no length has none. The left-to-right rule
    ``end = clamp(end, previous + min, dur - rest * min)`` has a closed form: less ``i * min_ds`` the
    lower bound is the maximum so far and the upper bound is one constant.
    """
    kept = segments.where("end_ds > start_ds").join(videos.where("dur_ds > 0").select("video_id", "dur_ds"), "video_id")
    inside = {c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("dur_ds")) for c in ("start_ds", "end_ds")}
    kept = kept.withColumns({"_s": inside["start_ds"], "_e": inside["end_ds"]})
    order = _by_video("_s", "_e", "pos")
    kept = kept.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("video_id"))})
    rise = F.max(F.col("_e") - F.col("_i") * min_ds).over(order)
    last = F.col("_i") == F.col("_n") - 1
    end = F.when(last, F.col("dur_ds")).otherwise(
        F.least(F.col("dur_ds") - (F.col("_n") - 1) * min_ds, F.greatest(F.lit(min_ds), rise)) + F.col("_i") * min_ds
    )
    kept = kept.withColumn("end_ds", end.cast("int"))
    kept = kept.withColumn("start_ds", F.coalesce(F.lag("end_ds").over(order), F.lit(0)).cast("int"))
    kept = kept.withColumn("seg_idx", F.col("_i").cast("int")).drop("_s", "_e", "_i", "_n", "dur_ds")
    rest = videos.where("dur_ds > 0").select("video_id", "dur_ds").join(kept.select("video_id").distinct(), "video_id", "left_anti")
    whole = rest.select("video_id", F.lit(0).alias("start_ds"), F.col("dur_ds").cast("int").alias("end_ds"), F.lit(0).alias("seg_idx"), F.lit("Full video event").alias("event"))
    return kept.unionByName(whole, allowMissingColumns=True)


def snap_boundaries(boundaries: DataFrame, cuts: DataFrame, *, window_ds: int = 5) -> DataFrame:
    """Each boundary (video_id, boundary_ds, ...) with the nearest cut within ``window_ds``: aligned_ds,
    source (cut or original) and delta_ds. Of two cuts as near, the earlier wins.

    The range condition is an equality of buckets of the window's width: a cut is filed in its own
    bucket and in both neighbours, so that a long video never meets all its cuts.
    """
    width = max(1, window_ds)
    at = F.floor(F.col("cut_ds") / width)
    filed = cuts.select("video_id", "cut_ds", F.explode(F.array(at - 1, at, at + 1)).alias("_b")).distinct()
    near = boundaries.withColumn("_b", F.floor(F.col("boundary_ds") / width)).join(filed, ["video_id", "_b"])
    near = near.where(F.abs(F.col("cut_ds") - F.col("boundary_ds")) <= window_ds)
    best = near.groupBy("video_id", "boundary_ds").agg(F.min(F.struct(F.abs(F.col("cut_ds") - F.col("boundary_ds")).alias("d"), "cut_ds")).alias("_c"))
    out = boundaries.join(best, ["video_id", "boundary_ds"], "left")
    return out.select(
        *boundaries.columns,
        F.coalesce("_c.cut_ds", "boundary_ds").cast("int").alias("aligned_ds"),
        F.when(F.col("_c").isNull(), "original").otherwise("cut").alias("source"),
        F.col("_c.d").cast("int").alias("delta_ds"),
    )


def align_segments(segments: DataFrame, cuts: DataFrame, videos: DataFrame, *, window_ds: int = 5) -> DataFrame:
    """Normalise, snap the boundaries between segments to cuts, rebuild the segments, normalise again.

    ``source`` and ``delta_ds`` tell of a segment's start; the first one's is the video's start.
    """
    first = normalize_segments(segments, videos)
    snapped = snap_boundaries(first.where("seg_idx > 0").select("video_id", "seg_idx", F.col("start_ds").alias("boundary_ds")), cuts, window_ds=window_ds)
    joined = first.join(snapped.select("video_id", "seg_idx", "aligned_ds", "source", "delta_ds"), ["video_id", "seg_idx"], "left")
    order = _by_video("seg_idx")
    moved = joined.withColumn("start_ds", F.coalesce("aligned_ds", "start_ds"))
    moved = moved.withColumn("end_ds", F.coalesce(F.lead("start_ds").over(order), F.col("end_ds")))
    moved = moved.withColumns({"source": F.coalesce("source", F.lit("video_start")), "pos": F.col("seg_idx")}).drop("aligned_ds", "seg_idx")
    return normalize_segments(moved, videos)


def _islands(df: DataFrame, order: Window, column: str = "emotion") -> DataFrame:
    """``_island`` numbers the runs of equal neighbours."""
    changed = F.coalesce((~F.lag(column).over(order).eqNullSafe(F.col(column))).cast("int"), F.lit(1))
    return df.withColumn("_new", F.when(F.row_number().over(order) == 1, 1).otherwise(changed)).withColumn("_island", F.sum("_new").over(order)).drop("_new")


def _appended(items: Column, join: str) -> Column:
    """Reasons in order, each appended unless it is empty or part of what is there already. One that repeats
    is such a part, so that only different ones are sought in the text."""
    return let(F.array_distinct(items), lambda d: F.aggregate(
        F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))),
        F.coalesce(F.get(d, F.lit(0)), F.lit("")),
        lambda text, r: F.when((F.coalesce(r, F.lit("")) == "") | F.contains(text, r), text).otherwise(F.concat(text, F.lit(join), r)),
    ))


def _reasoned(runs: DataFrame, reasons: DataFrame | None) -> DataFrame:
    """``runs`` with the reason that the members of ``_r`` make in order. Where they are keys of ``reasons``, keys alone
    travel with the runs, and a text moves once for each different sequence of keys that holds it."""
    if reasons is None:
        return runs.withColumn("reason", _appended(F.col("_r"), " "))
    runs = runs.withColumn("_r", F.array_distinct("_r"))
    each = runs.select("_r").distinct().select("_r", F.posexplode("_r").alias("_at", "_key"))
    found = each.join(reasons.select(F.col("key").alias("_key"), F.col("reason").alias("_text")), "_key", "left")
    texts = found.groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_t"))
    return runs.join(texts.select("_r", _appended(F.col("_t._text"), " ").alias("reason")), "_r")


def merge_same_emotion(segments: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Neighbours (by seg_idx) of one emotion become one: first start, last end, reasons appended. With ``reasons``
    (key, reason; a row for each key) the segments' ``reason`` is a key, so that long texts don't travel with them."""
    runs = _islands(segments, _by_video("seg_idx"))
    if "reason" not in segments.columns:
        runs = runs.withColumn("reason", F.lit(""))
    merged = runs.groupBy("video_id", "_island").agg(
        F.min_by("start_ds", "seg_idx").alias("start_ds"), F.max_by("end_ds", "seg_idx").alias("end_ds"), F.first("emotion").alias("emotion"),
        F.count("*").alias("n_merged"), F.array_sort(F.collect_list(F.struct("seg_idx", "reason")))["reason"].alias("_r"),
    )
    return _reasoned(merged, reasons).select("video_id", (F.col("_island") - 1).cast("int").alias("seg_idx"), "start_ds", "end_ds", "emotion", "reason", "n_merged")


def merge_affect_phases(segments: DataFrame, reasons: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbours of one non-empty emotion become one phase; also its events (joined by ``Then``) and
    descriptions. Returns the phases and a log with a row for each merge. ``reasons`` as for
    :func:`merge_same_emotion`."""
    order = _by_video("seg_idx")
    alone = F.when(F.coalesce("emotion", F.lit("")) == "", F.concat(F.lit("\x00"), F.col("seg_idx"))).otherwise(F.col("emotion"))
    runs = _islands(segments.withColumn("_key", alone), order, "_key")
    texts = F.array_sort(F.collect_list(F.struct("seg_idx", "event", "description", "reason")))
    grouped = runs.groupBy("video_id", "_island").agg(
        F.min("seg_idx").alias("first_idx"), F.max("seg_idx").alias("last_idx"), F.min_by("start_ds", "seg_idx").alias("start_ds"),
        F.max_by("end_ds", "seg_idx").alias("end_ds"), F.first("emotion").alias("emotion"), F.count("*").alias("n_merged"), texts.alias("_t"),
    )
    whole = grouped.select(
        "video_id", (F.col("_island") - 1).cast("int").alias("seg_idx"), "first_idx", "last_idx", "start_ds", "end_ds", "emotion", "n_merged",
        F.array_join("_t.event", " Then, ").alias("event"), F.array_join("_t.description", "\nThen, ").alias("description"), F.col("_t.reason").alias("_r"),
    )
    phases = _reasoned(whole, reasons).drop("_r")
    log = whole.where("n_merged > 1").select("video_id", "emotion", "first_idx", "last_idx", "start_ds", "end_ds", "n_merged")
    return phases, log


def repair_prediction(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Predicted segments (video_id, pos, start_ds, end_ds, emotion) repaired for evaluation: sorted by
    start, labels matched, equal neighbours merged, first start 0, last end the duration if it is
    more than half a second off, each start the previous end."""
    order = Window.partitionBy("video_id").orderBy("start_ds", "pos")
    sorted_ = segments.withColumns({"emotion": match_emotion(F.col("emotion")), "seg_idx": (F.row_number().over(order) - 1).cast("int")})
    merged = merge_same_emotion(sorted_).join(videos.select("video_id", "dur_ds"), "video_id")
    order = _by_video("seg_idx")
    last = F.lead("seg_idx").over(order).isNull() & (F.abs(F.col("end_ds") - F.col("dur_ds")) > 5)
    fixed = merged.withColumn("end_ds", F.when(last, F.col("dur_ds")).otherwise(F.col("end_ds")).cast("int"))
    return fixed.withColumn("start_ds", F.coalesce(F.lag("end_ds").over(order), F.lit(0)).cast("int")).drop("dur_ds", "n_merged")


def previous_segment_context(segments: DataFrame, columns: tuple[str, ...] = ("start_ds", "end_ds", "description", "emotion", "reason")) -> DataFrame:
    """Each segment with the previous one's columns as ``prev_…``."""
    order = _by_video("seg_idx")
    have = [c for c in columns if c in segments.columns]
    return segments.withColumns({f"prev_{c}": F.lag(c).over(order) for c in have})


def detect_cuts(frames: DataFrame, *, threshold: float = 35.0) -> DataFrame:
    """video_id, cut_ds: times at which the Bhattacharyya distance (times 100) of consecutive frame
    histograms reaches ``threshold``. ``frames`` has video_id, frame_idx, fps, hist array<double>."""
    order = _by_video("frame_idx")
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    pair = frames.withColumn("_prev", F.lag("hist").over(order)).where("_prev is not null")
    norm = F.sqrt(total(F.col("hist")) * total(F.col("_prev")))
    shared = F.aggregate(F.zip_with("hist", "_prev", lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda a, x: a + x)
    distance = F.sqrt(F.greatest(F.lit(0.0), 1 - F.when(norm > 0, shared / norm).otherwise(0.0))) * 100
    hit = pair.where(distance >= threshold)
    return hit.select("video_id", F.bround(F.col("frame_idx") * 10 / F.col("fps"), 0).cast("int").alias("cut_ds")).distinct()
