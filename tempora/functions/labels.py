"""Emotion labels and text words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels that evaluation and rewards know, in the order that fuzzy matching tries them.
EVAL_LABELS = (
    "Awkwardness", "Empathic Pain", "Fear", "Anger", "Sadness", "Relief", "Boredom", "Joy", "Aesthetic Appreciation",
    "Adoration", "Admiration", "Amusement", "Satisfaction", "Disgust", "Sexual Desire", "Confusion", "Romance", "Craving",
    "Horror", "Excitement", "Nostalgia", "Awe (or Wonder)", "Interest", "Calmness", "Surprise", "Entrancement", "Anxiety",
)
# The labels of the annotation pipeline; it has both names of awe.
PIPELINE_LABELS = (
    "Admiration", "Amusement", "Anger", "Anxiety", "Awe", "Awe (or Wonder)", "Boredom", "Calmness", "Confusion", "Craving",
    "Disgust", "Empathic Pain", "Entrancement", "Excitement", "Fear", "Horror", "Interest", "Joy", "Nostalgia", "Relief",
    "Romance", "Sadness", "Satisfaction", "Sexual Desire", "Surprise", "Awkwardness", "Adoration", "Aesthetic Appreciation",
)
# Words that are no terms of a description.
STOPWORDS = (
    "the", "a", "an", "and", "or", "with", "without", "from", "into", "onto", "under", "over", "scene", "segment", "video",
    "camera", "frame", "lighting", "background", "foreground", "movement", "motion", "view", "shot", "color", "colors",
    "area", "side", "part", "moment", "time", "transition", "atmosphere",
)
# Patterns of words and of terms (lower-cased).
WORD = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"
TERM = r"[a-z][a-z\-]{2,}"


def match_emotion(label: Column) -> Column:
    """The label itself if known; else the first known label that contains it or is contained in it,
    without regard to case; else ``Interest``. An empty text matches the first label."""
    known = F.array(*map(F.lit, EVAL_LABELS))
    text = F.lower(F.coalesce(label, F.lit("")))
    close = F.filter(known, lambda c: F.contains(text, F.lower(c)) | F.contains(F.lower(c), text))
    return F.when(label.isin(*EVAL_LABELS), label).otherwise(F.coalesce(F.get(close, F.lit(0)), F.lit("Interest")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Words of the text, or half its trimmed length where it has none."""
    n = F.size(words(text))
    return F.when(n > 0, n).otherwise(F.floor(F.length(F.trim(F.coalesce(text, F.lit("")))) / 2)).cast("long")


def token_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))
