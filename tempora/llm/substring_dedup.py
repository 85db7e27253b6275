"""Repeated passages removed by hashing paragraphs that are cut by content.

A paragraph is a sequence of ``min_words`` words whose hash is the least among ``REACH`` neighbouring
sequences (winnowing). That depends on nothing but these words, so that of a repeated passage of
``min_words + REACH - 1`` words or more one paragraph at least is taken wherever the passage starts and
ends, whatever its case and punctuation. Paragraphs are normalised (A to Z lower-cased, white space
folded) and hashed to 128 bits; digests are grouped over the whole corpus, the earliest ranked
occurrence stays and the rest goes, as spans of characters of the original text.

Neighbouring paragraphs of a text overlap or touch, so a run of repeated ones is one span. Its two
ends are then moved word by word as far as the words are those around the kept occurrence, by up to
``REACH - 1`` words, which is to where the passage really starts and ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import Scratch, bit_set, bits_at, bits_for, in_bits, materialize
from .hashing import _power_tables, mix, word_spans

#: Words of a paragraph.
MIN_WORDS = 25
#: Of so many neighbouring sequences of words one at least is a paragraph; ``MIN_WORDS`` at most, so
#: that neighbouring paragraphs leave no gap.
REACH = 25
SPANS = "array<struct<start:int,end:int>>"
MATCHES = "array<struct<at:int,to:int,clip:int,left:binary,right:binary>>"


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_spans`, with each character from U+3000 to U+9FFF (script without blanks) as a word."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((raw >= 0xE3) & (raw <= 0xE9))
    if not len(at):
        return word_spans(text)
    sides = np.r_[at, at + 3]
    words, start, end = word_spans(np.insert(raw, sides, 32).tobytes())
    origin = np.insert(np.arange(len(raw)), sides, -1)
    return words, origin[start], origin[end - 1] + 1


def _over(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` (or greatest) of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x, step = least(x[:-step], x[step:]), 2 * step
    return least(x[: len(x) - width + step], x[width - step :])


def winnowed(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Where the hashes stand that are the least of some ``reach`` neighbours, or of all if there are fewer."""
    reach = min(reach, len(hashes))
    least = np.pad(_over(hashes, reach, np.minimum), reach - 1)
    return np.flatnonzero(_over(least, reach, np.maximum) == hashes)


def paragraphs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two digests and the first word's place of each paragraph of a text's word hashes."""
    n = len(words)
    if n < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = _power_tables(n)
    both = []
    for w in (words, mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(w * power[:n], out=total[1:])
        both.append(mix((total[min_words:] - total[:-min_words]) * inverse[: n - min_words + 1] + np.uint64(min_words)))
    at = winnowed(both[0], min(REACH, min_words))
    return both[0][at].view(np.int64), both[1][at].view(np.int64), at


def folded(d1: np.ndarray, d2: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring paragraphs of one digest as one: its digests, the places of the first and the last. Where words
    repeat in a row, all sequences are such paragraphs; as neighbours leave no gap, they are one span."""
    first = np.flatnonzero(np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])][: len(at)])
    return d1[first], d2[first], at[first], at[np.r_[first[1:], len(at)] - 1] if len(at) else at


def _paragraph_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h, text = (batch.column(x) for x in ("doc", "h", "text"))
            found = [folded(*paragraphs(_words(t.as_py())[0], min_words)) for t in text.cast(pa.binary())]
            n = np.array([len(f[0]) for f in found], np.int64)
            for a in range(0, len(n), 256):  # texts of a batch of rows
                part, m = found[a : a + 256], n[a : a + 256]
                row = pa.array(np.repeat(np.arange(a, a + len(m)), m))
                d1, d2, at, to = (np.concatenate(x) for x in zip(*part, strict=True))
                i = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), doc.take(row), h.take(row), pa.array(i.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32))], ["d1", "d2", "doc", "h", "i", "at", "to"])

    return run


def _context_rows(min_words: int, docs: Broadcast, digests: Broadcast):
    """The paragraphs whose bits are set, with the hashes of the words around them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bits = 8 * (len(digests.value) - 4096)
        for batch in batches:
            batch = batch.filter(pa.array(bits_at(docs.value, batch.column("bit").to_numpy())))
            for row in range(len(batch)):
                words = _words(batch.column("text")[row].as_py().encode())[0]
                d1, d2, at, _ = folded(*paragraphs(words, min_words))
                pick = np.flatnonzero(bits_at(digests.value, d1 & (n_bits - 1)))
                if not len(pick):
                    continue
                left = [words[max(0, k - REACH + 1) : k].tobytes() for k in at[pick]]
                right = [words[k + min_words : k + min_words + REACH - 1].tobytes() for k in at[pick]]
                own = pa.array(np.full(len(pick), row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1[pick]), pa.array(d2[pick]), batch.column("doc").take(own), batch.column("h").take(own), pa.array(at[pick].astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    ["d1", "d2", "doc", "h", "at", "left", "right"],
                )

    return run


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common from their start on."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _spans_of(min_words: int):
    """Spans of characters to remove from a text, by its matches."""
    kind = to_arrow_type(_parse_datatype_string(SPANS))

    def spans(text: bytes, matches: list[dict]) -> list[dict]:
        words, start, end = _words(text)
        runs = []
        for m in matches:
            a, b = m["at"], m["to"] + min_words
            if m["left"]:
                a -= _same(words[:a][::-1], np.frombuffer(m["left"], np.uint64)[::-1])
            if m["right"]:
                b += _same(words[b:], np.frombuffer(m["right"], np.uint64))
            runs.append((max(a, m["clip"]), b))
        merged: list[list[int]] = []
        for a, b in sorted(r for r in runs if r[0] < r[1]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return [{"start": int(chars[start[a]]) - 1, "end": int(chars[end[b - 1] - 1])} for a, b in merged]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, matches in batches:
            each = zip(text.cast(pa.binary()), matches, strict=True)
            yield pa.array([spans(t.as_py(), m.as_py()) if m.is_valid and t.is_valid else None for t, m in each], kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SPANS)


def _key() -> tuple[Column, Column]:
    """What names a document: its doc_id (null last) and its text's hash, as ids may repeat."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text")


def repeated(scratch: Scratch, docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, h (see :func:`_key`) and matches of the texts that hold a paragraph again.

    The earliest occurrence of a paragraph by doc_id, then place, is kept. An occurrence that overlaps
    the kept one in its own text gives up only what follows it (``clip``). A match has the kept
    occurrence's words around it where it is the first or last of a run of paragraphs that one text
    has kept. One task holds the matches of one text at most.
    """
    doc, h = _key()
    texts = docs.where("text is not null").select(doc.alias("doc"), h.alias("h"), "text")
    key = ["d1", "d2"]
    found = scratch(texts.mapInArrow(_paragraph_rows(min_words), "d1 long, d2 long, doc long, h long, i int, at int, to int"), "paragraphs")
    # written, so that the joins on them have exchanges of their own, which Spark can split at a hot digest
    often = scratch(found.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("to") > F.col("at")).alias("twice")).where("n > 1 or twice").select(*key), "often")
    # rows that repeat doc_id and text give equal rows, which fold before they are shuffled
    copies = scratch(found.join(often, key, "left_semi").dropDuplicates(["d1", "d2", "doc", "h", "i", "at"]), "copies")
    scratch.done("paragraphs", "often")
    kept = scratch(copies.groupBy(*key).agg(F.min(F.struct("doc", "h", "at")).alias("kept")), "kept")
    # of neighbours of one digest that begin with the kept occurrence, the others repeat it: a run of their own
    again = copies.join(kept, key).where("to > at or struct(doc, h, at) <> kept").withColumn("anew", F.expr("struct(doc, h, at) = kept"))
    own = (F.col("doc") == F.col("kept.doc")) & (F.col("h") == F.col("kept.h"))
    again = again.select(*key, "doc", "h", "i", "at", "to", "anew", F.when(own, F.col("kept.at") + min_words).otherwise(0).alias("clip"), F.struct("kept.doc", "kept.h").alias("of"))
    run = Window.partitionBy("doc", "h").orderBy("i")  # within one text
    goes_on = lambda other, step, anew: F.coalesce((other("i").over(run) == F.col("i") + step) & (other("of").over(run) == F.col("of")) & ~anew, F.lit(False))
    ends = {"first": ~goes_on(F.lag, -1, F.col("anew")), "last": ~goes_on(F.lead, 1, F.lead("anew").over(run))}
    again = scratch(again.withColumns(ends).drop("of", "anew"), "again")
    scratch.done("copies")
    edges = again.where("first or last")
    wanted = kept.join(edges.select(*key).distinct(), key).select(*key, "kept.*")
    wanted = scratch(wanted, "wanted")
    spark, n_bits = docs.sparkSession, bits_for(wanted.count())
    place = F.pmod(F.xxhash64("doc", "h"), F.lit(n_bits))
    in_docs, in_digests = (spark.sparkContext.broadcast(bit_set(wanted.select(p.alias("p")), n_bits)) for p in (place, F.col("d1").bitwiseAND(n_bits - 1)))
    around = texts.select("doc", "h", "text", place.alias("bit")).mapInArrow(_context_rows(min_words, in_docs, in_digests), "d1 long, d2 long, doc long, h long, at int, left binary, right binary")
    around = around.join(wanted, [*key, "doc", "h", "at"], "left_semi").dropDuplicates(key).select(*key, "left", "right")
    edges = edges.join(scratch(around, "around"), key)
    at_edges = edges.select("doc", "h", "at", "to", "clip", F.when(F.col("first"), F.col("left")).alias("left"), F.when(F.col("last"), F.col("right")).alias("right"))
    inner = again.where("not (first or last)").select("doc", "h", "at", "to", "clip", F.lit(None).cast("binary").alias("left"), F.lit(None).cast("binary").alias("right"))
    return at_edges.unionByName(inner).groupBy("doc", "h").agg(F.collect_list(F.struct("at", "to", "clip", "left", "right")).alias("matches"))


def without(text: Column, spans: Column) -> Column:
    """The text less sorted, disjoint spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")


def deduplicated(docs: DataFrame, *, min_words: int = MIN_WORDS, details: bool = False) -> DataFrame:
    """``docs`` with the repeated passages cut from text; n_chars, where there is one, follows.

    With ``details``, also spans (of the original text), removed_chars and original_chars. Every row
    stays. Defined cases: a null text stays null; an empty text, or one of fewer words than
    ``min_words``, stays as it is; a text of ``min_words`` or more that repeats as a whole becomes empty in all
    but the first document (white space at its ends stays); repeated passages below ``min_words`` stay; rows that repeat doc_id and text are one document and get the same result; a null
    doc_id ranks last; other columns, whatever their names, stay; an empty table gives an empty result.

    Texts without a repeated passage are passed on where they are; only the others meet their matches.
    """
    names = docs.columns
    doc, h = _key()
    with Scratch() as scratch:
        matches = materialize(repeated(scratch, docs.select("doc_id", "text"), min_words=min_words), "matches")
    n_bits = bits_for(matches.count())
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n_bits))
    seen = in_bits(bit_set(matches.select(place("doc", "h").alias("p")), n_bits), docs.sparkSession)
    plain = docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"__{i}" for i, c in enumerate(names)))
    keyed = plain.withColumns({"__doc": doc, "__h": h}).withColumn("__seen", seen(place("__doc", "__h")))
    matched = keyed.where("__seen").join(matches.toDF("__doc", "__h", "__matches"), ["__doc", "__h"], "left")
    matched = matched.withColumn("__spans", _spans_of(min_words)("text", "__matches")).drop("__matches")
    joined = keyed.where("not __seen").withColumn("__spans", F.lit(None).cast(SPANS)).unionByName(matched)
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("__spans")))
    out = joined.withColumns({"__original": F.length("text").cast("long"), "text": text})
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    own = [F.col(p).alias(c) for p, c in zip(plain.columns, names, strict=True)]
    if not details:
        return out.select(*own)
    spans_of = F.coalesce("__spans", F.array().cast(SPANS))
    removed = F.aggregate(spans_of, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(*own, spans_of.alias("spans"), removed.alias("removed_chars"), F.coalesce("__original", F.lit(0)).cast("long").alias("original_chars"))
