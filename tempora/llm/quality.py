"""Quality classifier by compression with labelled dictionaries.

Two zstandard raw-content dictionaries are built from good and from bad labelled texts. A text is
compressed with either, and with none; the normalised size difference and the sizes themselves feed
a logistic calibration, fitted on labelled rows that are in neither dictionary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .udf import text_udf

#: Labelled rows of each class that the fit looks at, at most: the first by hash of doc_id, so that
#: reruns agree. Of these ``DICTIONARY_ROWS`` (half, if there are fewer than twice as many) make the
#: dictionary, the rest the calibration.
SAMPLE_ROWS, DICTIONARY_ROWS = 2000, 192
#: Characters of a piece and pieces of a text, spread all over it, that go to its dictionary, and bytes of a
#: dictionary: one of the longest texts fills a sixty-fourth of it.
PIECE_CHARS, PIECES, DICTIONARY_BYTES = 1024, 4, 262_144
#: Bytes of a text that are compressed at once.
PART_BYTES = 16_384
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def scorer(self):
        tools = _tools(self.good, self.bad)
        mean, scale, weights = self.mean, self.scale, self.weights

        def score(text: bytes | None) -> float:
            x = features(text or b"", tools)
            z = weights[-1] + sum(w * (v - m) / s for w, v, m, s in zip(weights, x, mean, scale, strict=False))
            return 1 / (1 + math.exp(-min(60.0, max(-60.0, z))))

        return score


def _tools(*contents: bytes) -> list[zstandard.ZstdCompressor]:
    """A compressor for each dictionary's content, and one without a dictionary."""
    tools = []
    for content in (*contents, b""):
        if content:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))
        else:
            tools.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
    return tools


def features(text: bytes, tools: list[zstandard.ZstdCompressor]) -> list[float]:
    """The size difference over the text's size and over both sizes, the ratios, and the log size. A long
    text is compressed in even parts of ``PART_BYTES`` at most, as a dictionary tells little far into a text."""
    n = max(1, len(text))
    step = -(-n // -(-n // PART_BYTES))
    good, bad, plain = (sum(len(t.compress(text[i : i + step])) for i in range(0, n, step)) for t in tools)
    return [(bad - good) / n, (bad - good) / (bad + good), good / n, bad / n, plain / n, math.log(step)]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method with step halving, and a ridge on all weights but the last."""
    z, penalty = np.c_[x, np.ones(len(x))], np.r_[np.full(x.shape[1], ridge), 1e-9]

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _pieces(text: Column) -> Column:
    """The text, or pieces all over it."""
    gap = F.greatest(F.length(text) - PIECE_CHARS, F.lit(0)) / (PIECES - 1)
    some = F.concat_ws("\n", *(F.substring(text, (gap * k).cast("int") + 1, F.lit(PIECE_CHARS)) for k in range(PIECES)))
    return F.when(F.length(text) <= PIECES * PIECE_CHARS, text).otherwise(some)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls are ignored; of several labels
    of a doc_id the largest counts). The sample is bounded by ``sample_rows`` a class; the shares of
    the classes, which set the intercept, are counted over all labels. Texts of the calibration are
    compressed whole, in tasks; the driver sees the dictionaries' pieces and six numbers a row. With
    labels of one class only, or none, every score is the share of class 1 (0.5 without labels).
    """
    spark = docs.sparkSession
    usable = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    share = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("id"), F.col("id"))
    known = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"))
    picked = []
    for q in (0, 1):
        ids = [r["id"] for r in usable.where(F.col("quality") == q).join(known, "id", "left_semi").orderBy(*order).limit(sample_rows).collect()]
        n = min(DICTIONARY_ROWS, len(ids) // 2)
        picked += [(x, q, k, k >= n) for k, x in enumerate(ids)]
    n0, n1 = share.get(0, 0), share.get(1, 0)
    prior = math.log((n1 + 0.5) / (n0 + 0.5))
    model = Model(b"", b"", [0.0] * 6, [1.0] * 6, [0.0] * 6 + [prior])
    if not picked:
        return model
    chosen = F.broadcast(spark.createDataFrame(picked, "id long, quality int, k int, fits boolean"))  # 2 * sample_rows rows at most
    with Scratch() as scratch:
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(chosen, "id").groupBy("quality", "k", "fits").agg(F.min("text").alias("text"))
        texts = scratch(texts, "sample")
        rows = texts.where("not fits").orderBy("quality", "k").select("quality", _pieces(F.col("text")).alias("text")).collect()
        model.bad, model.good = (b"\n".join(r["text"].encode() for r in rows if r["quality"] == q)[:DICTIONARY_BYTES] for q in (0, 1))
        contents = spark.sparkContext.broadcast((model.good, model.bad))

        def features_of():
            tools = _tools(*contents.value)
            return lambda text: features(text, tools)

        got = texts.where("fits").select("quality", "k", text_udf("array<double>", features_of)("text").alias("x")).orderBy("quality", "k").collect()
    y = np.array([r["quality"] for r in got])
    c0, c1 = int((y == 0).sum()), int((y == 1).sum())
    if c0 and c1:
        x = np.array([r["x"] for r in got])
        mean, scale = x.mean(0), x.std(0) + 1e-9
        w = _fit((x - mean) / scale, y)
        w[-1] += prior - math.log(c1 / c0)  # from the sample's shares to those of all labels
        model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()
    return model


def scored(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` plus score (0 to 1, higher: better; a column of this name is replaced), fitted on ``labels``.

    Every text is scored whole; labels, lang, source and doc_id are never inputs of a score. A null
    text scores as an empty one; repeated rows score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))
    return docs.withColumn("score", text_udf("double", lambda: shared.value.scorer())("text"))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns alone."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.where(text_udf("double", lambda: shared.value.scorer())("text") >= threshold)
