"""Token arrays, boxes and media arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.places import let


def truncate_tokens(ids: Column, max_length: int, how: str = "right", protected: tuple[int, ...] = ()) -> Column:
    """Places (from 0) of the tokens kept: protected tokens always, the others from the left
    (``right`` cuts the right end) or from the right (``left``). ``raise`` cuts nothing: a longer array
    fails the query with its length."""
    if how not in ("left", "right", "raise"):
        raise ValueError(f"unknown truncation: {how}")
    at = F.sequence(F.lit(0), F.size(ids) - 1)
    guard = F.filter(at, lambda i: F.get(ids, i).isin(*protected)) if protected else F.array().cast("array<int>")
    free = F.array_except(at, guard)
    room = F.greatest(F.lit(0), F.lit(max_length) - F.size(guard))
    part = F.slice(free, 1, room) if how == "right" else F.slice(free, F.greatest(F.lit(1), F.size(free) - room + 1), F.greatest(room, F.lit(0)))
    kept = F.array_sort(F.concat(guard, F.when(room > 0, part).otherwise(F.array().cast("array<int>"))))
    if how == "raise":
        kept = F.raise_error(F.concat(F.lit("a row of "), F.size(ids), F.lit(f" tokens is longer than {max_length}"))).cast("array<int>")
    return F.when(F.size(ids) > max_length, kept).when(F.size(ids) > 0, at).otherwise(F.array().cast("array<int>"))


def take(values: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(values, i))


def first_masked(labels: Column, value: float = -100) -> Column:
    """The array with its first member replaced, as the first token has no predecessor."""
    return F.transform(labels, lambda x, i: F.when(i == 0, F.lit(value).cast("int")).otherwise(x))


def split_tokens(df: DataFrame, ids: str, max_length: int) -> DataFrame:
    """A row for each chunk of ``max_length`` tokens, numbered by chunk."""
    n = F.ceil(F.size(ids) / max_length).cast("int")
    each = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
    return each.withColumn(ids, F.slice(ids, F.col("chunk") * max_length + 1, max_length))


def normalize_bbox(bbox: Column, width: Column, height: Column, norm: int = 1000) -> Column:
    """x and y of a box in thousandths of its image, rounded half-even."""
    return F.transform(bbox, lambda v, i: F.bround(v / F.when(i % 2 == 0, width).otherwise(height) * norm, 0).cast("int"))


def media_type(path: Column) -> Column:
    """image, video or audio by the extension; null for another."""
    from ..operators.manifest import AUDIO, IMAGE, VIDEO

    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*IMAGE), "image").when(ext.isin(*VIDEO), "video").when(ext.isin(*AUDIO), "audio")


def frame_plan(df: DataFrame, *, fps: float = 2.0, factor: int = 28, frame_factor: int = 2, min_frames: int = 4, max_frames: int = 768, min_pixels: int = 4 * 28 * 28, max_pixels: int = 16384 * 28 * 28) -> DataFrame:
    """Adds n_frames, frame_indices and the resized height and width for media with total_frames,
    video_fps, height, width. Sides are multiples of ``factor`` within the bounds of pixels; a side
    ratio above 200 gives nulls."""
    floor_to = lambda c, f: F.floor(c / f) * f
    total = F.col("total_frames")
    top = F.least(F.lit(max_frames), floor_to(total, frame_factor))
    want = F.least(F.greatest(total / F.col("video_fps") * fps, F.lit(min_frames)), F.lit(max_frames), total)
    n = floor_to(F.least(want, F.greatest(top, F.lit(min_frames))), frame_factor).cast("int")
    h, w = F.col("height"), F.col("width")
    near = lambda c: F.greatest(F.lit(factor), F.bround(c / factor, 0) * factor)
    area = near(h) * near(w)
    down, up = F.sqrt(h * w / F.lit(float(max_pixels))), F.sqrt(F.lit(float(min_pixels)) / (h * w))
    shrink = lambda c: F.greatest(F.lit(factor), floor_to(c / down, factor))
    grow = lambda c: F.ceil(c * up / factor) * factor
    side = lambda c: F.when(F.greatest(h, w) <= 200 * F.least(h, w), F.when(area > max_pixels, shrink(c)).when(area < min_pixels, grow(c)).otherwise(near(c))).cast("int")
    index = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.bround(i * (total - 1) / F.greatest(n - 1, F.lit(1)), 0).cast("int"))
    return df.withColumns({"n_frames": n, "frame_indices": index, "resized_height": side(h), "resized_width": side(w)})


def cosine_length(length: Column, correct: Column, max_len: int = 1000) -> Column:
    """A cosine schedule over the length: 1 to 0.5 for correct answers, -0.5 to 0 for wrong ones."""
    low, high = F.when(correct, 0.5).otherwise(0.0), F.when(correct, 1.0).otherwise(-0.5)
    return high - (high - low) * (1 - F.cos(length * math.pi / max_len)) / 2


def overlong_penalty(length: Column, max_len: int, cache: int) -> Column:
    return F.least(-(length - (max_len - cache)) / F.lit(float(cache)), F.lit(0.0))


def repetition_penalty(text: Column, n: int = 3, most: float = -1.0) -> Column:
    """``most`` times the share of word n-grams that repeat; 0 for a text of fewer words."""
    def share(words: Column) -> Column:
        grams = words
        for k in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(words, k, F.greatest(F.size(words), F.lit(1))), lambda g, w: F.concat(g, F.lit(" "), w))
        count = F.size(words) - (n - 1)  # the last n - 1 are null, as no word follows
        return F.when(F.size(words) < n, 0.0).otherwise((1 - F.size(F.array_distinct(F.slice(grams, 1, F.greatest(count, F.lit(1))))) / F.greatest(count, F.lit(1))) * most)

    # the text is split once: a column named again is computed again
    return let(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), share)


def format_match(text: Column, variant: str = "answer") -> Column:
    """1 if the whole text is a thought and an answer; ``react``: a thought, an action and its input."""
    pattern = r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z" if variant == "answer" else r"(?s)\A<think>.*?</think>\s*Action:.*?Action Input:.*"
    return text.rlike(pattern).cast("double")


def boxed_answer(text: Column) -> Column:
    """What stands in the box of the part after ``# Answer``, without LaTeX wrappers."""
    part = F.trim(F.when(F.contains(text, F.lit("# Answer")), F.get(F.split(text, "# Answer"), F.lit(1))).otherwise(text))
    boxed = F.when(part.rlike(r"\\boxed\{[^}]*\}"), F.trim(F.regexp_extract(part, r"\\boxed\{([^}]*)\}", 1))).otherwise(part)
    return F.trim(F.regexp_replace(F.regexp_replace(boxed, r"\\\(|\\\)|\\\[|\\\]", ""), r"[{}]", ""))


def action_match(pred: Column, ref: Column) -> Column:
    """1 if the last Action and its input agree with the reference's: equal actions, and JSON inputs
    whose keys agree; half credit for a key with another value, so that 1 needs all equal."""
    def last(text: Column, tag: str, to: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s){tag}:\s*(.*?)\s*{to}"), F.lit(1)), F.lit(-1))

    action = lambda t: last(t, r"Action", r"\n\s*Action Input:")
    given = lambda t: last(t, r"Action Input", r"(?:\nObservation:|\z)")
    maps = [F.from_json(given(t), "map<string,string>") for t in (pred, ref)]
    json_ = [F.json_object_keys(given(t)).isNotNull() for t in (pred, ref)]
    same = F.array_sort(F.map_entries(maps[0])) == F.array_sort(F.map_entries(maps[1]))
    return F.coalesce(F.when((action(pred) == action(ref)) & json_[0] & json_[1] & same, 1.0), F.lit(0.0))
