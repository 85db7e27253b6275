"""Operators on documents against plain Python, with the awkward rows each must bear."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tempora.llm import decontaminate, licenses, minhash_dedup, mixing, quality, substring_dedup
from tempora.llm.common import Scratch, load
from tempora.llm.hashing import PIECE, shingle_set, word_spans
from tempora.llm.queries import op6_quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, component_id string, scan string, score int, span string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def odd_rows():
    """Null, empty, blank, short, very long, tied and repeated rows, with columns of clashing names."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Solo"), (5, "solo"), (6, "a b"), (7, "A\tB"), (8, "a b c"), (None, "no id here at all"), (None, "no id here at all"), (None, None)]
    rows += [(10 + i, " ".join(base)) for i in range(5)] + [(10, " ".join(base)), (11, "another text of row eleven")]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(300, " ".join(rng.choice(vocabulary) for _ in range(60_000))), (301, "x" * 300_000), (302, "é ü 漢字 " * 2000)]
    return [(i, t, "s", "clash", "clash", 7, "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


def test_words_of_long_texts_in_pieces():
    rng = random.Random(1)
    text = " ".join(f"word{rng.randrange(1000)}" for _ in range(PIECE // 3))
    h, s, e = word_spans(text.encode())
    assert len(h) == len(text.split()) and [text[a:b] for a, b in zip(s[-3:], e[-3:])] == text.split()[-3:]
    assert len(set(h.tolist())) == len(set(text.split()))
    assert len(shingle_set(text.encode(), 2)) == len(set(zip(text.split(), text.split()[1:])))


def components(sets, percent=80):
    ids = list(range(len(sets)))
    parent = dict.fromkeys(ids)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return [find(i) for i in ids]


@pytest.mark.parametrize("limits", [(24, 32, None), (40, 3, 0.05), (24, 2, None)])
def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch, limits):
    k, list_limit, share = limits
    if share:
        monkeypatch.setattr(minhash_dedup, "least_share", lambda k, percent: share)
    monkeypatch.setattr(minhash_dedup, "PART", 7)
    got = sorted(map(tuple, minhash_dedup.near_duplicates(docs, shingle=2, k=k, list_limit=list_limit).collect()), key=repr)
    rows = [(r[0], r[1]) for r in odd_rows()]
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w] if w else [])))
    root = components(sets)
    least = defaultdict(list)
    for (i, _), r in zip(rows, root):
        least[r].append(i)
    want = []
    for (i, _), s, r in zip(rows, sets, root):
        ids = [x for x in least[r] if x is not None]
        c = i if not s else min(ids) if ids else None
        want.append((i, len(s), c, i == c))
    assert got == sorted(want, key=repr)


def test_dedup_keeps_one_row_of_each_component(spark, docs):
    out = minhash_dedup.deduplicated(docs, shingle=2)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert kept.count((10, None)) == 0 and sum(i == 10 for i, _ in kept) == 1
    assert sum(i == 11 for i, _ in kept) == 1  # its other text is a copy of 10's
    assert {1, 2, 3} <= {i for i, _ in kept} and (5, "solo") not in kept
    assert sum(i is None and t is not None for i, t in kept) == 2


def test_decontamination_equals_brute_force(spark, docs, monkeypatch):
    rows = odd_rows()
    long_text, base = next(r[1] for r in rows if r[0] == 300).split(), next(r[1] for r in rows if r[0] == 12).split()
    items = [(1, "!".join(long_text[500:515]).upper()), (2, " ".join(base[3:40])), (10, "Solo"), (3, None), (4, "..."), (None, "a b c"), (2, " ".join(base[3:40])), (5, "b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for i, t in items:
        w = fold(t)
        if i is not None:
            windows |= {(i, tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9) if w else 0)}
    want = []
    for r in rows:
        w, hit, found = fold(r[1]), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(str(i))
        want.append((r[0], len(w), len(hit), ",".join(sorted(found))))
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 12)
    for size in (1 << 20, 5):  # one automaton, and several
        out = decontaminate.contamination(docs.select("doc_id", "text"), bench, automaton_windows=size)
        got = [(r.doc_id, r.scan.n_words, r.scan.n_hit, ",".join(r.scan["items"])) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        for r in out.where("scan.n_hit > 0").collect():
            assert sum(len(fold(r.text[h.start : h.end])) for h in r.scan.hits) == r.scan.n_hit
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not n for _, _, n, _ in want)


def test_decontamination_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, none).count() == docs.count()


def test_substring_dedup_cuts_repeats_and_keeps_the_first(spark):
    rng = random.Random(4)
    passage = "The " + " ".join(f"p{rng.randrange(500)}" for _ in range(20)) + ". Then " + " ".join(f"q{rng.randrange(500)}" for _ in range(25)) + ". End " + " ".join(f"r{i}" for i in range(20)) + "."
    own = lambda i: " ".join(f"d{i}x{k}" for k in range(30))
    rows = [(i, f"{own(i)} {passage} Own {own(i)}é.") for i in (7, 3, 9)] + [(20, "Short. Short. Short."), (21, None), (22, ""), (None, passage), (30, "Of " * 200), (9, f"{own(9)} {passage} Own {own(9)}é.")]
    frame = spark.createDataFrame([(i, t, len(t or ""), "clash", "clash") for i, t in rows], "doc_id long, text string, n_chars long, spans string, doc string")
    out = substring_dedup.deduplicated(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].text == dict(rows)[3] and got[20].text == "Short. Short. Short." and got[21].text is None and got[22].text == ""
    for i in (7, 9):
        assert got[i].text.split() == own(i).split() + f"{own(i)}é.".split() and got[i].n_chars == len(got[i].text)  # Own follows the passage everywhere
    assert got[None].text.strip() == ""
    assert len(got[30].text.split()) == substring_dedup.MIN_WORDS
    for r in substring_dedup.deduplicated(frame.select("doc_id", "text"), details=True).collect():
        spans = [(s.start, s.end) for s in r.spans]
        assert r.removed_chars == sum(b - a for a, b in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert substring_dedup.deduplicated(frame.limit(0)).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] for _ in range(25)]
    rows = []
    for i in range(80):
        parts = [rng.choice(pool) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows += [(90, rows[3][1]), (91, " ".join(vocabulary[:7] * 30)), (92, "x " + " ".join(vocabulary[:7] * 9))]
    out = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), details=True)
    removal_is_right(dict(rows), {r.doc_id: [(s.start, s.end) for s in r.spans] for r in out.collect()})


def removal_is_right(texts, spans):
    """Every removed word is in a sequence of 25 words that stands earlier, and every word of a longer
    repeat is removed but for those near its ends, which may continue another occurrence."""
    n, edge, first = substring_dedup.MIN_WORDS, substring_dedup.REACH - 1, {}
    for i in sorted(texts):
        found = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i] or "")]
        gone = {k for k, (a, b, _) in enumerate(found) if any(s <= a and b <= e for s, e in spans[i])}
        assert sum(e - s for s, e in spans[i]) >= sum(found[k][1] - found[k][0] for k in gone)
        again = []
        for k in range(len(found) - n + 1):
            g = tuple(w for _, _, w in found[k : k + n])
            if first.setdefault(g, (i, k)) != (i, k):
                again.append(k)
        covered = {k + j for k in again for j in range(n)}
        assert gone <= covered
        overlap = {k + j for k in again for j in range(n) if first[tuple(w for _, _, w in found[k : k + n])][0] == i}
        runs, start = [], None
        for k in sorted(again) + [None]:
            if start is not None and k != last + 1:
                runs.append((start, last))
                start = None
            if k is not None:
                start, last = (k if start is None else start), k
        for a, b in runs:
            if b - a + 1 >= substring_dedup.REACH:
                assert set(range(a + edge, b + n - edge)) - overlap <= gone


def test_near_duplicates_whose_common_values_lie_in_long_lists(spark):
    ranked = sorted((int(shingle_set(w.encode(), 1)[0]), w) for w in (f"v{i}" for i in range(40_000)))
    low, high = [w for _, w in ranked[:60]], iter([w for _, w in ranked[100:]])
    common, extra, more, very = low[:24:2], low[1:24:2], low[24:36], low[36:48]
    private = lambda n: [next(high) for _ in range(n)]
    base = common + more + private(76)
    rows = [base, base + extra + private(13)]  # similarity 0.8; half of the second's sketch is its own
    rows += [common + very + private(300) for _ in range(45)] + [very + private(300) for _ in range(45)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame, shingle=1).collect()}
    assert got == {i: 0 if i == 1 else i for i in range(len(rows))}


@pytest.mark.parametrize("kind", ["lower", "Capitals.", "cjk"])
def test_substring_dedup_finds_passages_cut_anywhere(spark, kind):
    rng = random.Random(14)
    word = {"lower": lambda: f"w{rng.randrange(10**6)}", "Capitals.": lambda: rng.choice(["W{}", "w{}.", "w{}", "w{}"]).format(rng.randrange(10**6)), "cjk": lambda: chr(rng.randrange(0x4E00, 0x9FA0))}[kind]
    glue = "" if kind == "cjk" else " "
    source = [word() for _ in range(3000)]
    rows, passages = [(0, glue.join(source))], {}
    for i in range(1, 60):
        n = rng.randint(49, 70) if i < 50 else substring_dedup.MIN_WORDS + substring_dedup.REACH - 1
        at = rng.randrange(len(source) - n)
        before, after = ([word() for _ in range(rng.randint(5, 60))] for _ in range(2))
        passages[i] = before, source[at : at + n], after
        rows.append((i, glue.join(before + source[at : at + n] + after)))
    got = {r.doc_id: r.text for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i, (before, passage, after) in passages.items():
        left = list(got[i]) if kind == "cjk" else got[i].split()
        assert left == before + after


def test_equal_rows_are_one_document(spark):
    """However often a row repeats, its text has one group of matches, those of one text."""
    text = " ".join(f"word{i}" for i in range(600))
    sizes = []
    for n in (1, 100_000):
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string").unionByName(spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")))
        with Scratch() as scratch:
            sizes.append([len(r.matches) for r in substring_dedup.repeated(scratch, frame).collect()])
    assert sizes[0] == sizes[1] and len(sizes[0]) == 1 and sizes[0][0] < 600
    got = substring_dedup.deduplicated(frame.limit(2000)).groupBy("doc_id", "text").count().collect()
    assert sorted(map(tuple, got), key=repr) == [(1, text, 1), (None, "", 1999)]


def test_mix_meets_targets(spark, docs):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 900)), rng.choice(["a", "b", "b", "b", "c", None, "ä"])) for i in range(300)]
    rows += [(1, None, "b"), (2, "", "b"), (400, "x " * 50_000, "big"), (401, "one two", "tiny"), (401, "one two", "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.plan_mix(frame, block=16)
    got = mix.taken().join(mix.sources, "i").collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, total, full = {}, sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(16 * 3, 0.05 * target[s])
    again = mixing.plan_mix(frame.repartition(5), block=16)
    key = lambda m: sorted((repr(r.doc_id), r.size, r.taken) for r in m.taken().collect())
    assert key(mix) == key(again)
    texts = mix.texts(frame).collect()
    per = defaultdict(int)
    for r in texts:
        assert len(r.text.split()) == r.words
        per[r.source] += r.words
    assert dict(per) == {s: n for s, n in taken.items() if n}
    assert mixing.plan_mix(frame.limit(0)).taken().count() == 0


def test_a_permutation_is_one():
    import numpy as np

    for n in (1, 2, 3, 17, 1000):
        index = np.arange(n)
        assert sorted(mixing._permuted(index, np.full(n, n), np.full(n, 12345, np.uint64)).tolist()) == list(range(n))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = op6_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    good = [r.predicted for r in rows if r.quality == 1]
    assert right > 0.97 and sum(good) / len(good) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_bears_odd_rows(spark, docs):
    labels = spark.createDataFrame([(None, 1), (5, None), (6, 3)], "doc_id long, quality int")
    out = quality.scored(docs.drop("score"), labels)
    assert out.count() == docs.count() and {r.score for r in out.collect()} == {0.5}
    few = spark.createDataFrame([(i, i % 2) for i in range(100, 150)] + [(100, 1)], "doc_id long, quality int")
    scores = [r.score for r in quality.scored(docs.drop("score"), few).collect()]
    assert all(0 <= s <= 1 for s in scores)
    kept = quality.accepted(docs, few)
    assert kept.columns == docs.columns and quality.accepted(docs.limit(0), few).count() == 0


def test_quality_of_very_long_texts(spark):
    """Texts of over a million characters, made of those of one class, score like their class."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    told = docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").orderBy("doc_id").select("quality", "text").collect()
    long_ = []
    for q in (0, 1):
        text = "\n".join(r.text for r in told if r.quality == q)
        long_.append((q, (text * (1_000_000 // len(text) + 1))[:1_100_000]))
    model = quality.train(docs, labels).scorer()
    got = {q: model(t.encode()) for q, t in long_}
    assert got[0] < quality.THRESHOLD <= got[1]


def test_license_scan(spark, docs):
    mit = next(t for i, n, t in licenses.TEMPLATES if (i, n) == ("MIT", "text"))
    rows = [
        (1, "Prose.\nLicensed under the Apache License, Version 2.0.\nMore prose."), (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "x\n\nMIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit.replace("Software", "Program", 1) + "\n\ny"), (4, "We like a license plate."), (5, None), (6, ""),
        (7, "Released under the MIT License.\n" + "word " * 500 + "\nLicensed under CC BY-NC 4.0."), (8, "All rights reserved."), (9, "licensed under CC BY 4.0"), (10, "license " * 9000),
    ]
    got = {r.doc_id: r for r in licenses.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {1: "Apache-2.0", 2: "GPL-3.0", 3: "MIT", 4: "", 5: "", 6: "", 7: "CC-BY-NC-4.0,MIT", 8: "LicenseRef-Proprietary", 9: "CC-BY-4.0", 10: ""}
    text = dict(rows)
    one = got[1].findings[0]
    assert text[1][one.start : one.end] == "Licensed under the Apache License, Version 2.0" and one.wording == 1.0 and not one.missing
    full = got[3].findings[0]
    assert full.template == "text" and full.missing == ["software"] and full.added == ["program"]
    assert licenses.summary(docs.select("doc_id", "text")).agg(F.sum("n_findings")).first()[0] == 0


def test_license_findings_equal_brute_force(spark):
    """Every template planted whole in prose is found at its place, as a scan that confirms all templates
    without compression would find it; and prose gives nothing."""
    rows, places = [], {}
    for i, (license_, name, text) in enumerate(licenses.TEMPLATES):
        cue = "" if any(c in text.lower().encode() for c in licenses.CUES) else "Licensed under "
        before, after = f"Some prose about nothing.\n\n{cue}", "\n\nMore prose about nothing at all."
        rows.append((i, before + text + after))
        places[i] = license_, len(before), len(before) + len(text)
    rows.append((-1, "Some prose about nothing.\n" * 50))
    got = {r.doc_id: r.findings for r in licenses.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = {i: [w for w, _, _ in licenses.words(t)] for i, (_, _, t) in enumerate(licenses.TEMPLATES)}
    missed = []
    for i, (license_, a, b) in places.items():
        best = [f for f in got[i] if f.license == license_]
        holders = [license_ for j, w in wanted.items() if w == wanted[i] for license_ in [licenses.TEMPLATES[j][0]]]
        if not best and not any(f.license in holders for f in got[i]):
            missed.append((license_, licenses.TEMPLATES[i][1], [f.license for f in got[i]]))
        assert all(a - 20 <= f.start < f.end <= b for f in got[i])
    assert not missed and not got[-1]


def exact_notices(text):
    """Leftmost, longest places of the words of a template, with what it is a template of."""
    found, at, out = licenses.words(text or ""), 0, []
    templates = [(x[0], [w for w, _, _ in licenses.words(x[2])]) for x in licenses.TEMPLATES]
    while at < len(found):
        here = [(len(t), name) for name, t in templates if [w for w, _, _ in found[at : at + len(t)]] == t]
        if here:
            n, name = max(here)
            out.append((found[at][1], found[at + n - 1][2], {name for m, name in here if m == n}))
        at += n if here else 1
    return out


def test_license_findings_equal_an_exact_scan(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    n = 0
    for r in licenses.scanned(docs).collect():
        want = exact_notices(r.text)
        assert [(f.start, f.end) for f in r.findings] == [(a, b) for a, b, _ in want]
        assert all(f.license in names and f.reduction >= licenses.LEAST_REDUCTION and f.wording == 1.0 for f, (_, _, names) in zip(r.findings, want))
        n += len(want)
    assert n > 20


def test_compression_decides_what_is_confirmed(monkeypatch):
    text = "Prose that goes before it.\nThis work is licensed under the GNU General Public License, version 3.\nMore of it.\n".encode()
    assert [f["license"] for f in licenses.Scanner()(text)] == ["GPL-3.0"]
    right = licenses.Scanner.ranked
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, tokens, templates: right(self, tokens, templates)[::-1])
    assert licenses.Scanner()(text) == []
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, tokens, templates: right(self, tokens, templates)[3:])
    assert [f["license"] for f in licenses.Scanner()(text)] != ["GPL-3.0"]


def test_equal_templates_tie_to_the_first(monkeypatch):
    first = licenses.TEMPLATES[0]
    monkeypatch.setattr(licenses, "TEMPLATES", [("A", *first[1:]), ("B", *first[1:])])
    found = licenses.Scanner()(f"Licensed under this.\n{first[2]}\n".encode())
    assert {f["license"] for f in found} == {"A"}


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 150)], "doc_id long, quality int")
    assert licenses.summary(none).count() == decontaminate.contamination(none, bench).count() == minhash_dedup.near_duplicates(none).count() == 0
    assert quality.scored(none, labels).count() == minhash_dedup.deduplicated(none).count() == mixing.plan_mix(none).texts(none).count() == 0


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "MIT License", 0, "x", "x", "x", "x")], "doc_id long, text string, score int, scan string, findings string, licenses string, n_findings string")
    got = licenses.summary(frame).first()
    assert (got.licenses, got.n_findings, got.score, got.scan) == ("", 0, 0, "x")  # two words are no notice
    got = licenses.summary(frame.withColumn("text", F.lit("Released under the MIT License."))).first()
    assert (got.licenses, got.n_findings, got.score, got.scan) == ("MIT", 1, 0, "x")
    bench = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    assert decontaminate.contamination(frame, bench).first().scan.n_hit == 2
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scored(frame, none).first().score == 0.5


def test_small_sources_and_equal_rows_of_a_mix(spark):
    rows = [(i, "w " * 1000, "big") for i in range(300)] + [(1000, "a b c d e " * 20, "tiny")] + [(None, "same text of all " * 5, "zz")] * 500 + [(-(1 << 63), "same text of all " * 5, "zz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.plan_mix(frame)
    got = mix.taken().join(mix.sources, "i").collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    targets = {r.source: r.target for r in got}
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= max(1.0, 0.02 * targets[s]) for s in targets), (dict(taken), targets)
    assert sum(r.words for r in mix.texts(frame).collect()) == sum(taken.values())


def test_scores_equal_plain_python(spark, sf_dir):
    """The scores of all texts, from the fitted dictionaries and weights, without the operator's code."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    m = quality.train(docs, labels)
    assert m.good and m.bad and 0 < max(len(m.good), len(m.bad)) <= quality.DICTIONARY_BYTES

    def size(part, content):
        extra = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}
        if content:
            extra["dict_data"].precompute_compress(level=quality.LEVEL)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, **({"write_dict_id": False} | extra if content else {})).compress(part))

    def score(text):
        raw = (text or "").encode()
        n = max(1, len(raw))
        parts = math.ceil(n / quality.PART_BYTES)
        step = math.ceil(n / parts)
        cut = [raw[k * step : (k + 1) * step] for k in range(math.ceil(n / step))]
        good, bad, none = (sum(size(c, content) for c in cut) for content in (m.good, m.bad, b""))
        x = [(bad - good) / n, (bad - good) / (bad + good), good / n, bad / n, none / n, math.log(step)]
        z = m.weights[6] + sum(w * (v - a) / s for w, v, a, s in zip(m.weights, x, m.mean, m.scale))
        return 1 / (1 + math.exp(-max(-60, min(60, z))))

    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(r.score == pytest.approx(score(r.text), abs=1e-9) for r in got)
    assert any(len(r.text or "") > quality.PART_BYTES for r in got)


def test_mix_draws_and_joins_equal_plain_python(spark):
    """Multinomial counts by shard, blocks by permutations, and the texts that the blocks stand for; columns
    of other names change nothing."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{s}{rng.randrange(999)}" for _ in range(rng.randint(0, 60))), s) for i, s in enumerate(rng.choices(["a", "b", "c", None], [6, 3, 1, 1], k=150))]
    extra = ["d", "h", "i", "b", "at", "size", "slot", "shard", "block", "target"]
    frame = spark.createDataFrame([(*r, *["own"] * len(extra)) for r in rows], "doc_id long, text string, source string" + "".join(f", {c} string" for c in extra))
    mix = mixing.plan_mix(frame, block=8, shard=50, seed=7)
    laid, sources = mix.laid.collect(), {r.i: r for r in mix.sources.collect()}
    text = {i: (t or "").split() for i, t, _ in rows}
    words_of = {i: [] for i in sources}
    for r in sorted((r for r in laid if r.size), key=lambda r: (r.i, r.at)):
        assert r.at == len(words_of[r.i])
        words_of[r.i] += text[r.d]
    assert {i: len(w) for i, w in words_of.items()} == {i: r.source_size for i, r in sources.items()}
    blocks = {i: math.ceil(len(w) / sources[i].b) for i, w in words_of.items()}
    slots = {i: min(3 * blocks[i], round(sources[i].target / (len(words_of[i]) / blocks[i]))) if blocks[i] else 0 for i in sources}
    got = mix.slots.collect()
    share = np.array([slots[i] for i in sorted(slots)]) / sum(slots.values())
    drawn = sum(np.random.default_rng([7, k]).multinomial(min(50, sum(slots.values()) - k * 50), share) for k in range(math.ceil(sum(slots.values()) / 50)))
    taken = [sum(r.i == i for r in got) for i in sorted(slots)]
    assert taken == [slots[i] for i in sorted(slots)] and len(got) == sum(drawn)
    assert sorted((r.shard, r.slot) for r in got) == [(k // 50, k % 50) for k in range(len(got))]
    for i, n in blocks.items():  # each turn of a source takes each of its blocks once
        times = [sum(r.block == b for r in got if r.i == i) for b in range(n)]
        assert max(times, default=0) - min(times, default=0) <= 1
    pieces = defaultdict(list)
    for r in mix.texts(frame).collect():
        pieces[r.shard, r.slot].append((r.at, r.text.split()))
    for r in got:
        b = sources[r.i].b
        assert [w for _, t in sorted(pieces[r.shard, r.slot]) for w in t] == words_of[r.i][r.block * b : (r.block + 1) * b]
    plain = sorted(map(tuple, mixing.plan_mix(frame.select("doc_id", "text", "source"), block=8, shard=50, seed=7).taken().collect()), key=repr)
    assert plain == sorted(map(tuple, mix.taken().collect()), key=repr)


def test_a_word_repeated_in_a_row_is_one_match_of_a_text(spark):
    """Each sequence of such words is a paragraph of one digest; as neighbours they go together."""
    own = lambda i: " ".join(f"d{i}w{j}" for j in range(30))
    rows = [(i, f"{own(i)} {' '.join(['so'] * 200)} {own(-i)}") for i in range(1, 9)] + [(99, " ".join(["p q"] * 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with Scratch() as scratch:
        found = {r.doc: len(r.matches) for r in substring_dedup.repeated(scratch, docs).collect()}
    assert max(found.values()) <= 2 and set(found) == {*range(1, 9), 99}
    left = {r.doc_id: r.text.split() for r in substring_dedup.deduplicated(docs).collect()}
    assert left[1].count("so") == 25 and all("so" not in left[i] for i in range(2, 9))
    assert all(left[i] == f"{own(i)} {own(-i)}".split() for i in range(2, 9))
