"""Benchmark decontamination with one Aho-Corasick automaton over the items' windows.

Texts and items become words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A to Z lower-cased, and words of
items become numbers. The automaton holds every window of ``window`` consecutive item words (a shorter
item is one window) as a sequence of numbers, runs over each text once, and its hits are mapped back to
characters of the original.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_set, bits_for, in_bits, lower_ascii, materialize
from .udf import text_udf

#: Words of a window.
WINDOW = 10
#: Windows that one automaton takes, about: ``WINDOW`` nodes each, some 340 MB in a worker (84 MB for 100,000
#: as measured). More windows go to further automata, one pass over the texts each.
AUTOMATON_WINDOWS = 400_000
#: Words of a piece of an item; longer items are cut to overlapping pieces that have the same windows.
PIECE_WORDS = 10_000
_SEPARATORS = [c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)]
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SEPARATORS else c for c in range(256))
_WORD = re.compile(rb"[^ ]+")

SCAN = "struct<n_words:long,n_hit:long,items:array<string>,hits:array<struct<start:long,end:long>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Finds the windows of items (item, text) in sequences of words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        places: dict[tuple[int, ...], int] = {}
        self.holders: list[list[str]] = []
        for item, text in items:
            w = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                k = places.setdefault(tuple(w[i : i + window]), len(self.holders))
                if k == len(self.holders):
                    self.holders.append([])
                if item not in self.holders[k][-1:]:
                    self.holders[k].append(item)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for sequence, k in places.items():
            self.found.add_word(sequence, (k, len(sequence)))
        if places:
            self.found.make_automaton()
        # a window lies in a run of words that items have, of its own length at least
        self.known = re.compile(rb"\x01{%d,}" % min(map(len, places), default=1))

    def hits(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """First word, end word and number of each window that occurs."""
        if not words or not self.holders:
            return []
        numbers, out = tuple(map(self.numbers.get, words, repeat(0))), []
        for run in self.known.finditer(bytes(map(bool, numbers))):
            at = run.start()
            out += [(at + end - n + 1, at + end + 1, k) for end, (k, n) in self.found.iter(numbers[at : run.end()])]
        return out


_last: list[tuple[str, Automaton]] = []  # of this worker process, so that its tasks share what one has built


def _scan(shared: Broadcast, window: int) -> Callable[[], Callable[[bytes | None], dict]]:
    name = uuid.uuid4().hex

    def make() -> Callable[[bytes | None], dict]:
        if not _last or _last[0][0] != name:
            _last.clear()
            _last.append((name, Automaton(shared.value, window)))
        automaton = _last[0][1]

        def of_text(text: bytes | None) -> dict:
            words = words_of(text or b"")
            n_hit, items, hits = _hits(text, automaton.hits(words), automaton.holders)
            return {"n_words": len(words), "n_hit": n_hit, "items": items, "hits": hits}

        return of_text

    return make


def _hits(text: bytes | None, found: list[tuple[int, int, int]], holders: list[list[str]]) -> tuple:
    """Words hit, items found, and the hit passages as character offsets of the original."""
    if not found:
        return 0, [], []
    runs: list[list[int]] = []
    for a, b in sorted({(a, b) for a, b, _ in found}):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    spans = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    chars, at, spot = {}, 0, 0
    for b in sorted({x for r in runs for x in (spans[r[0]][0], spans[r[1] - 1][1])}):
        spot += len(text[at:b].decode("utf-8"))
        chars[b], at = spot, b
    passages = [{"start": chars[spans[a][0]], "end": chars[spans[b - 1][1]]} for a, b in runs]
    items = sorted({x for *_, k in found for x in holders[k]})
    return sum(b - a for a, b in runs), items, passages


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item, text, windows: the items in pieces of about ``PIECE_WORDS`` words with all their windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where("item is not null and text is not null").distinct()
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    cut = items.select("item", words.alias("w")).where("size(w) > 0").withColumn("windows", F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("windows") - 1, F.lit(PIECE_WORDS))))
    text = F.array_join(F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + window - 1)), " ")
    return cut.select("item", text.alias("text"), F.least(F.col("windows") - F.col("at"), F.lit(PIECE_WORDS)).alias("windows"))


def _groups(docs: DataFrame, benchmark: DataFrame, window: int, limit: int) -> Iterator[Broadcast]:
    """The items in broadcasts of about ``limit`` windows each; the driver holds one at a time."""
    with Scratch() as scratch:
        pieces = scratch(_pieces(benchmark, window), "items")
        total = pieces.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
        n = max(1, -(-total // limit))
        for i in range(n):
            part = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
            yield docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in part.collect()])


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, automaton_windows: int = AUTOMATON_WINDOWS) -> DataFrame:
    """``docs`` plus the column ``scan``: n_words, n_hit, items, hits (a column of this name is replaced).

    ``items`` are the item_ids with windows in the text, as sorted strings; ``hits`` the passages of
    hit words as character offsets [start, end). A word in several occurrences counts once. Defined
    cases: a null or empty text has no words and no hits; items without words or with a null item_id
    are left out; repeated items count once by item_id; without items nothing is hit; an empty table
    gives an empty result.

    The items fall into groups of about ``automaton_windows``. The first is scanned in the rows
    themselves. Each further group is a pass of its own over the texts, which writes the hits by the
    text's hash, and only texts with such hits are shuffled to meet them; so neither a worker nor the
    driver holds more than one group.
    """
    groups = _groups(docs, benchmark, window, automaton_windows)
    out = docs.withColumn("scan", text_udf(SCAN, _scan(next(groups), window))("text"))
    key = (F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text")))
    more = None
    for group in groups:
        texts = docs.where("text is not null").select(key[0].alias("h1"), key[1].alias("h2"), text_udf(SCAN, _scan(group, window))("text").alias("s"))
        found = materialize(texts.where("s.n_hit > 0").dropDuplicates(["h1", "h2"]), "hits")
        group.unpersist()
        more = found if more is None else more.unionByName(found)
    if more is None:
        return out
    more = materialize(more.groupBy("h1", "h2").agg(F.collect_list("s").alias("more")), "hits")
    n_bits = bits_for(more.count())
    place = lambda c: F.pmod(c, F.lit(n_bits))
    seen = in_bits(bit_set(more.select(place(F.col("h1")).alias("p")), n_bits), docs.sparkSession)
    out = out.withColumns({"__h1": key[0], "__h2": key[1]}).withColumn("__seen", seen(place(F.col("__h1"))))
    met = out.where("__seen").join(more.toDF("__h1", "__h2", "__more"), ["__h1", "__h2"], "left")
    met = met.withColumn("scan", F.when(F.col("__more").isNull(), F.col("scan")).otherwise(_merged(F.col("text"), F.concat(F.array("scan"), "__more"))))
    return out.where("not __seen").unionByName(met.drop("__more")).drop("__h1", "__h2", "__seen")


def _merged(text: Column, scans: Column) -> Column:
    """One scan of those of several groups."""
    def join(runs: Column, h: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))
        return F.when(h["start"] <= last["end"], F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(h)))

    each = lambda c: F.flatten(F.transform(scans, lambda s: s[c]))
    hits = F.aggregate(F.array_sort(each("hits")), F.array().cast("array<struct<start:long,end:long>>"), join)
    words_in = lambda h: F.regexp_count(F.substring(lower_ascii(text), h["start"].cast("int") + 1, (h["end"] - h["start"]).cast("int")), F.lit(WORD))
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + words_in(h))
    return F.struct(F.get(scans, F.lit(0))["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.array_sort(F.array_distinct(each("items"))).alias("items"), hits.alias("hits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns alone, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*(c if c == "text" else f"__{i}" for i, c in enumerate(names)))
    return contamination(plain, benchmark, window=window).where("scan.n_hit = 0").drop("scan").toDF(*names)
