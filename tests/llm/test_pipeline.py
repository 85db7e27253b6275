"""Each stage of the pipeline against plain Python, on what the stage before it kept."""

import re

import corpus_pipeline
from test_documents import removal_is_right
from tempora.llm import quality, substring_dedup
from tempora.llm.common import load, materialize

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near dedup", "substring dedup", "decontamination", "mixing"]
    docs, kept = load(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name.replace(" ", "-"))
        kept.append(docs)
    source = load(spark, SF, "documents")
    assert all(d.columns == source.columns for d in kept[:-1])
    whole, good, alone, cut, clean = texts(source), *map(texts, kept[:-1])
    # 6: what scores under the threshold goes
    scores = {r.doc_id: r.score for r in quality.scored(source, load(spark, SF, "labels")).collect()}
    assert set(good) == {i for i in whole if scores[i] >= quality.THRESHOLD} and all(good[i] == whole[i] for i in good)
    # 8: the least document of each component of 5-word shingle sets
    sets = {}
    for i, t in good.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(alone) == {i for i in sets if find(i) == i}
    # 7: spans of sequences of words that stand earlier
    out = substring_dedup.deduplicated(kept[1], details=True).select("doc_id", "spans").collect()
    spans = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in out}
    removal_is_right(alone, spans)
    for i, t in alone.items():
        gone = {k for a, b in spans[i] for k in range(a, b)}
        assert cut[i] == "".join(c for k, c in enumerate(t) if k not in gone)
    # 2: documents with a window of an item go
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 10]) for w in (fold(r.text) for r in load(spark, SF, "benchmark").collect()) for k in range(max(1, len(w) - 9)) if w}
    hit = {i for i, t in cut.items() if any(tuple(w[k : k + n]) in windows for w in [fold(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    assert set(clean) == set(cut) - hit and hit
    # 5: the mix is made of pieces of the documents, and reruns agree
    mix = kept[-1].collect()
    assert all(r.text.strip() in clean[r.doc_id] and len(r.text.split()) == r.words for r in mix)
    again = corpus_pipeline.mixed(spark, kept[-2].repartition(3), SF).collect()
    assert sorted(map(repr, mix)) == sorted(map(repr, again))


def awkward(spark):
    """Good documents of the smallest table, and null, empty, repeated, long and tied rows, with columns
    whose names the stages use inside."""
    source = load(spark, SF, "documents")
    scores = {r.doc_id: r.score for r in quality.scored(source, load(spark, SF, "labels")).collect()}
    rows = [tuple(r) for r in source.collect() if scores[r.doc_id] >= 0.9 and len((r.text or "").split()) > 60][:40]
    text, other = rows[0][1], rows[1][1]
    rows += [(rows[0][0], text, *rows[0][2:])] * 3  # the same row again
    rows += [(None, text, "en", "x", 1)] * 3 + [(None, other + " " + text, None, None, None)]
    rows += [(9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, " \n", None, None, None), (9004, "one two", "en", "y", 7), (9004, "another text of this id", "en", "y", 7)]
    rows += [(9005, (other + " ") * 200, "en", "x", 1), (9006, "x" * 200_000, "en", "x", 1)]
    extra = ["component_id", "spans", "score", "size", "taken", "print", "h", "doc", "i", "source_size"]
    kinds = source.schema.simpleString()[7:-1].replace(":", " ")
    frame = spark.createDataFrame([(*r, *["own"] * len(extra)) for r in rows], kinds + "".join(f", {c} string" for c in extra))
    return frame.repartition(3), extra


def test_stages_bear_awkward_rows(spark):
    docs, extra = awkward(spark)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF), f"awkward-{name.replace(' ', '-')}"))
        assert kept[-1].columns == docs.columns
        assert all(r[c] == "own" for r in kept[-1].collect() for c in extra)
    key = lambda r: (r.doc_id, r.text)
    whole, good, alone, cut, clean = ([key(r) for r in df.collect()] for df in kept)
    ids = {k[0] for k in whole}
    assert set(good) <= set(whole) and all(good.count(k) == whole.count(k) for k in set(good))
    # of the rows of one text that has words, one stays: that of the least id
    by_text = {}
    for i, t in good:
        if t and t.split():
            by_text.setdefault(t, []).append(i)
    for t, owners in by_text.items():
        stays = [i for i, x in alone if x == t]
        assert len(stays) <= 1 and (not stays or stays[0] == min((i for i in owners if i is not None), default=None))
    blank = lambda keys: sorted((k for k in keys if not (k[1] or "").split()), key=repr)
    assert blank(alone) == blank(good)
    assert len(cut) == len(alone) and {i for i, _ in cut} <= ids
    assert set(clean) <= set(cut) and blank(clean) == blank(cut)
    mix = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    assert mix and {r.doc_id for r in mix} <= {i for i, _ in clean}


def test_stages_of_nothing(spark):
    docs = load(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == load(spark, SF, "documents").columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
