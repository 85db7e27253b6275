"""Manifests, checks and filters of records about media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import EVAL_LABELS, PIPELINE_LABELS, STOPWORDS, TERM
from .places import let

IMAGE, VIDEO, AUDIO = ("jpg", "jpeg", "png", "bmp", "webp", "gif", "tiff"), ("mp4", "avi", "mov", "mkv", "webm", "flv"), ("mp3", "wav", "flac", "ogg", "m4a", "aac")


def resolve_media_path(df: DataFrame, files: DataFrame, root: str, prefix: tuple[str, str] | None = None) -> DataFrame:
    """Adds resolved: the first of file, root/file, root/videos/name, root/videos/id.mp4, root/id.mp4
    that is among ``files``; else the file as it is. With ``prefix`` (old, new), the old start of a
    path is swapped and relative paths get the root, without a look at ``files``."""
    f = F.col("file")
    if prefix:
        swapped = F.when(f.startswith(prefix[0]), F.concat(F.lit(prefix[1]), F.substring(f, len(prefix[0]) + 1, 1 << 30))).otherwise(f)
        return df.withColumn("resolved", F.when(swapped.startswith("/"), swapped).otherwise(F.concat(F.lit(f"{root}/"), swapped)))
    name, id_ = F.element_at(F.split(f, "/"), -1), F.col("video_id").cast("string")
    tries = [f, F.concat(F.lit(f"{root}/"), f), F.concat(F.lit(f"{root}/videos/"), name), F.concat(F.lit(f"{root}/videos/"), id_, F.lit(".mp4")), F.concat(F.lit(f"{root}/"), id_, F.lit(".mp4"))]
    there = files.select(F.col("file").alias("_path")).distinct()
    each = df.select("video_id", F.posexplode(F.array(*tries)).alias("_i", "_path")).where("_path is not null")
    found = each.join(there, "_path").groupBy("video_id").agg(F.min_by("_path", "_i").alias("_found"))
    return df.join(found, "video_id", "left").withColumn("resolved", F.coalesce("_found", "file")).withColumn("exists", F.col("_found").isNotNull()).drop("_found")


def static_scores(frames: DataFrame) -> DataFrame:
    """video_id, mean Hamming distance of consecutive 64-bit frame hashes, mean flow; 0 for one frame."""
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    pair = frames.withColumn("_d", F.bit_count(F.col("ahash").bitwiseXOR(F.lag("ahash").over(order))))
    out = pair.groupBy("video_id").agg(F.avg("_d").alias("hamming"), F.avg(F.when(F.col("_d").isNotNull(), F.col("flow"))).alias("flow"))
    return out.select("video_id", F.coalesce("hamming", F.lit(0.0)).alias("hamming"), F.coalesce("flow", F.lit(0.0)).alias("flow"))


def static_video_filter(frames: DataFrame, *, hash_max: float = 4.0, flow_max: float = 0.25) -> DataFrame:
    """The scores with static: little change of both hashes and flow."""
    return static_scores(frames).withColumn("static", (F.col("hamming") <= hash_max) & (F.col("flow") <= flow_max))


def build_manifest(videos: DataFrame, files: DataFrame, scores: DataFrame | None = None, *, min_duration: float = 1.0) -> DataFrame:
    """videos (video_id, file, duration) with keep and drop_reason, tested in this order: missing_video,
    missing_duration, duration_lt_minimum, static_or_slideshow, or empty."""
    out = videos.join(files.select("file", F.lit(True).alias("_there")).distinct(), "file", "left")
    static = F.lit(False)
    if scores is not None:
        out, static = out.join(scores.select("video_id", "static"), "video_id", "left"), F.coalesce("static", F.lit(False))
    reason = (
        F.when(F.col("_there").isNull(), "missing_video").when(F.col("duration").isNull(), "missing_duration")
        .when(F.col("duration") < min_duration, "duration_lt_minimum").when(static, "static_or_slideshow").otherwise("")
    )
    return out.withColumn("drop_reason", reason).withColumn("keep", F.col("drop_reason") == "").drop("_there", "static")


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("drop_reason").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"))


def keep_filter(df: DataFrame) -> DataFrame:
    """Rows whose keep is true or missing."""
    return df.where(F.coalesce("keep", F.lit(True))) if "keep" in df.columns else df


def route_errors(df: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows fit to process, and rows with an error: the one they came with, or the missing columns."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    own = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    out = df.withColumn("error", F.coalesce(own, F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))))
    return out.where("error is null"), out.where("error is not null")


def segment_count_guard(df: DataFrame, lo: int = 1, hi: int = 6) -> DataFrame:
    """Adds error where the number of segments (n_segments) is out of bounds."""
    bad = ~F.coalesce(F.col("n_segments"), F.lit(0)).between(lo, hi)
    return df.withColumn("error", F.when(bad, F.concat(F.lit("segments: "), F.coalesce("n_segments", F.lit(0)).cast("string"))))


def validate_segments(rows: DataFrame, segments: DataFrame, *, tol: float = 0.15) -> DataFrame:
    """video_id, error: the first rule that a row or its segments break, null for a valid row.

    ``rows``: video_id, file, duration, roles (array), is_json; ``segments``: video_id, seg_idx,
    start, end, emotion, reason (keys that are missing are null).
    """
    order = Window.partitionBy("video_id").orderBy("seg_idx")
    s = segments.join(rows.select("video_id", "duration"), "video_id")
    s = s.withColumns({"_pe": F.lag("end").over(order), "_pm": F.lag("emotion").over(order), "_last": F.lead("seg_idx").over(order).isNull(), "_first": F.row_number().over(order) == 1})
    far = lambda a, b: F.abs(a - b) > tol
    rule = (
        F.when(F.col("start").isNull() | F.col("end").isNull() | F.col("emotion").isNull() | F.col("reason").isNull(), "missing_key")
        .when(F.col("end") <= F.col("start"), "end_not_after_start").when(~F.col("emotion").isin(*EVAL_LABELS), "unknown_emotion")
        .when(F.trim("reason") == "", "empty_reason").when(F.col("_first") & far(F.col("start"), F.lit(0.0)), "first_start_not_zero")
        .when(~F.col("_first") & far(F.col("start"), F.col("_pe")), "not_contiguous").when(~F.col("_first") & (F.col("emotion") == F.col("_pm")), "same_emotion")
        .when(F.col("_last") & far(F.col("end"), F.col("duration")), "end_not_duration")
    )
    first = s.withColumn("_rule", rule).groupBy("video_id").agg(F.count("*").alias("_n"), F.min_by("_rule", F.when(F.col("_rule").isNotNull(), F.col("seg_idx"))).alias("_rule"))
    out = rows.join(first, "video_id", "left")
    error = (
        F.when(F.coalesce("file", F.lit("")) == "", "missing_video").when(F.coalesce("duration", F.lit(0.0)) <= 0, "bad_duration")
        .when((F.size("roles") < 2) | (F.get("roles", F.lit(0)) != "human") | (F.get("roles", F.lit(1)) != "gpt"), "bad_turns")
        .when(~F.coalesce("is_json", F.lit(False)), "answer_not_json").when(F.coalesce("_n", F.lit(0)) == 0, "empty_segments").otherwise(F.col("_rule"))
    )
    return out.select("video_id", error.alias("error"))


def check_media_tokens(messages: DataFrame, media: DataFrame, files: DataFrame) -> DataFrame:
    """conv_id, n_image_tokens, n_video_tokens, n_images, n_videos, problems (joined by ;).

    Tokens in user turns are counted against the media of the conversation; of both mismatches the
    image one is reported; media tokens in answers and files that aren't there are further problems.
    """
    ask, answer = F.col("role") == "user", F.col("role") == "assistant"
    n = lambda tag, who: F.sum(F.when(who, F.regexp_count("content", F.lit(tag))).otherwise(0)).cast("long")
    tokens = messages.groupBy("conv_id").agg(n("<image>", ask).alias("n_image_tokens"), n("<video>", ask).alias("n_video_tokens"), (n("<image>", answer) + n("<video>", answer)).alias("_answer"))
    there = files.select(F.col("file").alias("path"), F.lit(True).alias("_there")).distinct()
    kinds = media.join(there, "path", "left").groupBy("conv_id").agg(
        F.count_if(F.col("kind") == "image").alias("n_images"), F.count_if(F.col("kind") == "video").alias("n_videos"), F.count_if(F.col("_there").isNull()).alias("_gone")
    )
    out = tokens.join(kinds, "conv_id", "left").fillna(0, ["n_images", "n_videos", "_gone"])
    mismatch = F.when(F.col("n_image_tokens") != F.col("n_images"), "image_mismatch").when(F.col("n_video_tokens") != F.col("n_videos"), "video_mismatch")
    problems = F.array_compact(F.array(mismatch, F.when(F.col("_answer") > 0, "tokens_in_answer"), F.when(F.col("_gone") > 0, "missing_media")))
    return out.withColumn("problems", F.array_join(problems, ";")).drop("_answer", "_gone")


def media_check_stats(checked: DataFrame) -> DataFrame:
    has = lambda p: F.count_if(F.contains("problems", F.lit(p)))
    return checked.agg(
        F.count("*").alias("total"), F.count_if(F.col("problems") == "").alias("valid"), has("missing_media").alias("missing_media"), has("mismatch").alias("token_mismatch"),
        has("tokens_in_answer").alias("answer_tokens"), F.count_if(F.expr("n_images > 0 and n_videos = 0")).alias("image_rows"), F.count_if(F.expr("n_images = 0 and n_videos > 0")).alias("video_rows"), F.count_if(F.expr("n_images > 0 and n_videos > 0")).alias("mixed_rows"),
    )


def top_terms(df: DataFrame, *, max_terms: int = 8) -> DataFrame:
    """id, terms: the words of text by count, then by word; stopwords and short words left out, and texts
    without a word. A row is counted where it is: its words are sorted and runs of equal ones measured."""
    found = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda w: F.btrim(w, F.lit("-")))
    words = F.sort_array(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))

    def ranked(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        return let(starts, lambda s: F.array_sort(F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(w) + 1)), lambda a, b: F.struct((a - b).alias("less"), F.get(w, a - 1).alias("word")))))

    best = let(words, lambda w: F.when(F.size(w) > 0, F.transform(F.slice(ranked(w), 1, max_terms), lambda x: x["word"])))
    # exploded, as a filter on the terms would have them computed twice
    return df.select("id", F.explode(F.filter(F.array(best), lambda t: F.size(t) > 0)).alias("terms"))


def grounding_filter(terms: DataFrame, detections: DataFrame, *, score: float = 0.25, min_terms: int = 1) -> DataFrame:
    """Segments (id, terms) with the number of distinct labels detected at ``score`` or more, and
    passed: enough of them, or no terms to look for."""
    n = detections.where(F.col("score") >= score).groupBy("id").agg(F.count_distinct(F.lower("label")).alias("n_grounded"))
    out = terms.join(n, "id", "left").withColumn("n_grounded", F.coalesce("n_grounded", F.lit(0)).cast("long"))
    return out.withColumn("passed", (F.col("n_grounded") >= min_terms) | (F.coalesce(F.size("terms"), F.lit(0)) <= 0))


def top3_emotions(df: DataFrame, keys: tuple[str, ...] = ("top3_emotions", "top3emotion", "candidate_emotions", "topK", "topk")) -> Column:
    """The first list among ``keys`` (even an empty one) cut to three and rid of blanks; else the three
    best of the map emotions, of equal ones the first."""
    have = [c for c in keys if c in df.columns]
    listed = F.coalesce(*[F.col(c) for c in have]) if have else F.lit(None).cast("array<string>")
    cut = F.filter(F.slice(listed, 1, 3), lambda e: F.coalesce(F.trim(e), F.lit("")) != "")
    if "emotions" not in df.columns:
        return cut
    entries = F.map_entries("emotions")
    ranked = F.array_sort(F.transform(entries, lambda e, i: F.struct((-F.coalesce(e["value"], F.lit(0.0))).alias("s"), i.alias("i"), e["key"].alias("k"))))
    return F.coalesce(cut, F.transform(F.slice(ranked, 1, 3), lambda e: e["k"]))


def attach_top3(df: DataFrame, labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds top3: of the labels, else of the metadata, else empty. Both have video_id and top3."""
    out = df.join(labels.select("video_id", F.col("top3").alias("_l")), "video_id", "left").join(metadata.select("video_id", F.col("top3").alias("_m")), "video_id", "left")
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    return out.withColumn("top3", F.coalesce(full("_l"), full("_m"), F.array().cast("array<string>"))).drop("_l", "_m")


def candidates_or_default(top3: Column) -> Column:
    """The candidates, or the first three labels where there are none."""
    return F.when(F.size(top3) > 0, top3).otherwise(F.array(*map(F.lit, PIPELINE_LABELS[:3])))
