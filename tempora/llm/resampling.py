"""Importance resampling towards a target: hashed n-gram features of raw and target texts give each text
a weight, and noise of the Gumbel distribution on top of it draws without replacement.

Features are counted by segments. A text is cut at newlines, equal lines of the whole corpus are folded,
the features of each distinct line are counted once and multiplied by its occurrences; n-grams that
cross line ends are added text by text. Words hold no newline, so nothing else is cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.places import constant_longs, with_row_index

from .common import lower_ascii, materialize

#: What ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` finds once A to Z are lower-cased.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"


def words(text: Column) -> Column:
    """The words of a text, in its own case; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ngrams(w: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by one blank. ``w`` must be a column, not an expression."""
    if n == 1:
        return w
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda k: k <= F.size(w) - (n - 1))
    return F.transform(starts, lambda k: F.array_join(F.slice(w, k, n), " "))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets))


def _crossing(w: Column, ends: Column, n: int) -> Column:
    """Runs of ``n`` words over a line end: ``ends`` has the words up to each line's end. A run that
    crosses several is filed under the first."""
    runs = F.transform(ends, lambda e: F.transform(F.filter(F.sequence(e - (n - 1), e - 1), lambda s: (s >= 0) & (s + n <= F.size(w))), lambda s: F.struct(s.alias("s"), e.alias("e"))))
    first = F.zip_with(runs, F.concat(F.array(F.lit(0)), ends), lambda r, before: F.filter(r, lambda x: x["s"] >= before))
    return F.transform(F.flatten(F.filter(first, lambda r: r.isNotNull())), lambda x: F.array_join(F.slice(w, x["s"] + 1, n), " "))


def feature_counts(texts: DataFrame, *, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: occurrences of the features of all rows of ``texts`` (text), runs of 1 to ``n``
    words. At most ``buckets`` rows. Lines and features are folded before they are shuffled; letters are
    lower-cased once for each distinct feature."""
    lines = texts.where("text is not null").select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    cut = lines.select("times", words(F.col("line")).alias("w")).where(F.size("w") > 0)
    parts = [cut.select("times", F.explode(ngrams(F.col("w"), k)).alias("f")) for k in range(1, n + 1)]
    if n > 1:
        sizes = F.transform(F.split("text", "\n", -1), lambda line: F.size(words(line)))
        whole = texts.where(F.contains("text", F.lit("\n"))).select(words(F.col("text")).alias("w"), sizes.alias("s"))
        # running word counts at the line ends inside the text, each once
        ends = F.aggregate("s", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        whole = whole.select("w", F.filter(F.array_distinct(ends), lambda e: (e > 0) & (e < F.size("w"))).alias("e"))
        parts += [whole.select(F.lit(1).cast("bigint").alias("times"), F.explode(_crossing(F.col("w"), F.col("e"), k)).alias("f")) for k in range(2, n + 1)]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    distinct = out.groupBy("f").agg(F.sum("times").alias("times"))
    return distinct.groupBy(bucket(lower_ascii(F.col("f")), buckets).alias("bucket")).agg(F.sum("times").alias("n"))


def gains(raw: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, scale: int = 1000) -> list[int]:
    """The gain of each bucket: floor(scale * ln of the ratio of its smoothed shares in target and raw).
    ``buckets`` numbers reach the driver."""
    s, t = ({r["bucket"]: r["n"] for r in feature_counts(x, n=n, buckets=buckets).collect()} for x in (raw, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return [math.floor(scale * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int], *, n: int = 1, seed: int = 2024, scale: int = 1000) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``: the sum of gains over a text's features, and that
    plus Gumbel noise by sha256 of ``seed:doc_id``. A null or empty text has weight 0; a null id has no score."""
    table = constant_longs(gain)
    none = F.lit(0).cast("bigint")
    cut = docs.select("doc_id", words(lower_ascii(F.col("text"))).alias("w"))
    total = none
    for k in range(1, n + 1):
        total = total + F.aggregate(ngrams(F.col("w"), k), none, lambda a, f: a + F.get(table, bucket(f, len(gain))))
    many = sum((F.greatest(F.size("w") - (k - 1), F.lit(0)).cast("bigint") for k in range(1, n + 1)), none)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    out = cut.select("doc_id", F.size("w").cast("bigint").alias("n_words"), many.alias("n_features"), total.alias("weight"))
    return out.withColumn("score", F.col("weight") + F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: all rows of ``docs`` (doc_id, text), of which the
    floor(percent * N / 100) highest scores among the N texts of ``least_words`` words or more are drawn.

    Ties go to the smaller id. Rows that repeat take part each, with ranks of their own; null ids have no
    score and take no part; null and empty texts have no features; an empty table gives none, an empty
    target weighs by rarity alone. Other columns are left out, so their names can't clash. Ranks come from
    counted ranges of scores, so that no task sorts all.
    """
    scores = materialize(weighed(docs, gains(docs, target, n=n, buckets=buckets), n=n, seed=seed), "scores")
    able = scores.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    ranked = with_row_index(able, [-F.col("score"), "doc_id"], "rank")
    rank = F.when(F.col("rank") < able.count() * percent // 100, F.col("rank") + 1)
    rest = scores.where((F.col("n_words") < least_words) | F.col("score").isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", rank).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
