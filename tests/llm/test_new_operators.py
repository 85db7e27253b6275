"""Personal data, centroids and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tempora.llm import centroids, pii, resampling
from tempora.llm.common import load
from tempora.llm.queries import SQL, op11_pii, op12_centroids, op13_resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    return {"email": True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base_of(text):
    return {k: [(m.start(), m.end(), m.group()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in BASE.items()}


def terms_of(text):
    return [(m.start(), m.end(), m.group().translate(LOWER)) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "") if re.search(r"[^0-9]", m.group())]


def general(t):
    return t[:3] + "*" if len(t) >= 6 else None


def hidden_of(texts):
    """Terms by text, as (start, end, general form or None), by the definition in ``pii``."""
    blank = lambda t: re.sub(BASE["email"], lambda m: " " * len(m.group()), t or "")
    forms = lambda ws: set(ws) | {general(w) for w in ws if general(w)}
    nf, near, docs_of = Counter(), Counter(), defaultdict(set)
    around = []
    for t in texts:
        nf.update(forms([w for _, _, w in terms_of(t)]))
        pairs = set()
        for k in BASE:
            body = t or "" if k == "email" else blank(t)
            matches = [(m.start(), m.end(), m.group()) for m in re.finditer(BASE[k], body) if k != "card" or 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
            for i, (a, b, v) in enumerate(matches):
                if not valid(k, v):
                    continue
                e = f"{k}:" + (v.translate(LOWER) if k in ("email", "ip") else re.sub("[^0-9]", "", v))
                before = body[matches[i - 1][1] if i else 0 : a]
                after = body[b : matches[i + 1][0] if i + 1 < len(matches) else len(body)]
                ws = [w for *_, w in terms_of(before)][-10:] + [w for *_, w in terms_of(after)][:10]
                pairs |= {(e, "")} | {(e, f) for f in forms(ws)}
        around.append(pairs)
        for p in pairs:
            near[p] += 1
            docs_of[p].add(t)
    shown = {
        (e, f) for (e, f), n in near.items()
        if f and n >= 3 and len(docs_of[e, f]) > 1 and 2 * n >= nf[f] and math.log2(n * len(texts) / (near[e, ""] * nf[f])) >= 3
    }
    out = []
    for t, pairs in zip(texts, around):
        put = {}
        for e, f in pairs & shown:
            if not f.endswith("*"):
                g = general(f)
                g = None if (e, g) in shown else g
                put[f] = g if f not in put or (put[f] and g) else None
        out.append([(a, b, put[w]) for a, b, w in terms_of(blank(t)) if w in put])
    return out


def people():
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "sta", "Ren", "ü") for b in ("ka", "to", "re", "ß") for c in ("ning", "s", "ment", "la")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(160)]
    for i in range(6):  # a name and a nickname that stand with one address only
        rows.append((200 + i, f"{rng.choice(words)} ask Zebediah Quist or zeb77 at zeb.q@mail.example.com {rng.choice(words)} Zebediah again {rng.choice(words)} " + " ".join(rng.choice(words) for _ in range(20)) + " QUIST"))
        rows.append((300 + i, f"{rng.choice(words)} call Quarterly on +1 (555) 010-9999 {rng.choice(words)}"))
    rows += [(400 + i, "the same text with onlyhere and copy@copies.example.org") for i in range(5)]
    rows += [(500, "quarrel"), (501, "quarter"), (502, "quarry x"), (503, "quartz y"), (504, "quarantine z"), (505, "quark v"), (506, "quarto w"), (507, "quarts")]
    odd = ["a@b.c_d@e.f", "x@y.z.@q.w", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3.256", "4111 1111 1111 1111 41111111111111112222 4111-1111-1111-1111-", "+1 234 (567) 890) +12 +1........2 ++1 2345678901234567", "é@x.y ü 12.1.1.1é", "", None, " ", "@", "𝔘 me@x.io 𝔘", "1" * 5000, "a" * 5000, "x@" * 3000, "+1" + "(" * 3000, "1.1." * 2000, "4111111111111111 " * 300]
    rows += [(600 + i, t) for i, t in enumerate(odd)]
    return rows + [(600, odd[0]), (None, "no id me@x.io")]


@pytest.fixture(scope="module")
def private(spark):
    rows = people()
    df = spark.createDataFrame([(i, t, "h", "terms", 1) for i, t in rows], "doc_id long, text string, h string, terms string, found int").repartition(3)
    return rows, pii.found(df)


def test_personal_data_equals_brute_force(private):
    rows, out = private
    assert out.columns == ["doc_id", "text", "h", "terms", "found"]
    got = sorted(((r.doc_id, r.text, {k: [tuple(x) for x in r.found[k]] for k in (*BASE, "term")}) for r in out.collect()), key=repr)
    want = [(i, t, base_of(t) | {"term": h}) for (i, t), h in zip(rows, hidden_of([t for _, t in rows]))]
    assert got == sorted(want, key=repr)
    terms = {(i, t[a:b], g) for i, t, f in want for a, b, g in f["term"]}
    assert {(200, "Zebediah", None), (200, "Quist", None), (200, "QUIST", None), (200, "zeb77", None), (300, "Quarterly", "qua*")} <= terms
    assert not any(i and 400 <= i < 405 or i and i < 200 for i, *_ in terms)


def test_sanitised_texts(spark, private):
    rows, _ = private
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(df).collect() if r.doc_id is not None}
    by_id = dict(rows)
    assert "[email]" in got[200] and "Zebediah" not in got[200] and "zeb77" not in got[200] and "[removed]" in got[200]
    assert "qua*" in got[300] and "[phone]" in got[300] and "Quarterly" not in got[300]
    assert got[610] == "𝔘 [email] 𝔘" and got[607] is None and got[606] == ""
    assert all(got[i] == by_id[i] for i in range(160))


def test_personal_data_of_nothing(spark):
    assert pii.found(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pii_query(spark, sf_dir):
    rows = {r.doc_id: r for r in op11_pii(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        base = base_of(t)
        s = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b, _ in base[k])
        assert rows[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest() and rows[i].spans.startswith(s)
        assert [rows[i][f"n_{k}"] for k in BASE] == [len(base[k]) for k in BASE]


def test_long_texts_take_linear_time(spark):
    text = "see 4111111111111111 and jo@x.org of Name " * 12_000
    df = spark.createDataFrame([(1, text), (2, "9" * 500_000), (3, "a." * 250_000)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in pii.found(df).select("doc_id", F.size("found.card").alias("n")).collect()}
    assert got == {1: 12_000, 2: 0, 3: 0}


def clustered(rows, k, dims, rounds, seed=3):
    keep = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    keep = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in keep]
    first = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in keep:
            of[near(v)[1]].append(v)
        for j, vs in of.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return c, sorted(((i, *near(v)) for i, v in keep), key=repr)


def test_centroids_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 1.5, -2.25]) + rng.gauss(0, 0.2) for _ in range(5)]) for i in range(300)]
    rows += [(1, rows[1][1]), (1, [0.5] * 5), (None, [0.25] * 5), (400, None), (401, []), (402, [1.0] * 4), (403, [1.0, None, 1.0, 1.0, 1.0]), (404, [math.nan] * 5), (405, [math.inf] * 5), (406, [-1e300] * 5), (407, [1e30] * 5), (408, [0.0] * 5), (409, [-0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance long").repartition(3)
    for rounds in (0, 4):
        out = centroids.cluster(df, k=4, dims=5, rounds=rounds)
        c, want = clustered(rows, 4, 5, rounds)
        assert out.centroids == c
        assert sorted(((r.id, r.distance, r.cluster) for r in out.assigned.collect()), key=repr) == want
        assert sum(out.inertia) == sum(d for _, d, _ in want)
    few = centroids.cluster(df.where("vec_id in (2, 3)"), k=4, dims=5)
    assert len(few.centroids) == 2 and few.assigned.count() == 2
    none = centroids.cluster(df.where("false"), k=4, dims=5)
    assert none.centroids == [] and none.assigned.collect() == []


@pytest.mark.parametrize("name,query", [("op12_centroids", op12_centroids), ("op13_resampling", op13_resampling)])
def test_queries_equal_their_sql(spark, sf_dir, name, query):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_native_plans(spark, sf_dir):
    for query in (op11_pii, op12_centroids, op13_resampling):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def toks(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def grams(t, n):
    w = toks(t)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


LINES = ["a b c", "", "x", "A B c", "--", "one two three four five six seven", "É é über 12", "  "]


def lined():
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    return rows + [(1, rows[1][1]), (1, "a b\n\nc"), (None, "a b c " * 20), (500, None), (501, ""), (502, "\n\n"), (503, "w " * 50_000)]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_brute_force(spark, n):
    rows, target = lined(), ["a b c", None, "seven six\nfive", ""]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, weight int, score int, rank int").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, resampling.resampled(docs, goal, n=n, buckets=97, percent=30, least_words=5).collect()), key=repr)
    hashed = lambda g: zlib.crc32(g.encode()) % 97
    s, t = (Counter(hashed(g) for x in xs for g in grams(x, n)) for xs in ([x for _, x in rows], target))
    assert {r.bucket: r.n for r in resampling.feature_counts(docs, n=n, buckets=97).collect()} == dict(s)
    a, b = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + 97) / ((s[k] + 1) * (b + 97)))) for k in range(97)]
    out = []
    for i, x in rows:
        weight = sum(gain[hashed(g)] for g in grams(x, n))
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams(x, n)), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(toks(x))])
    able = sorted((r for r in out if r[4] >= 5 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able) if k < len(able) * 30 // 100}
    assert got == sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resampled(none, some).collect() == []
    assert [r.weight for r in resampling.resampled(some, none, percent=100).collect()] != [None]
