"""Rules that literal rows and properties show."""

import hashlib
import itertools
import json
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions import tokens
from tempora.functions.intervals import clamp, interval_iou
from tempora.functions.json_text import extract_json_object
from tempora.functions.labels import EVAL_LABELS, PIPELINE_LABELS, jaccard, match_emotion, token_set
from tempora.operators import advantage, annotate, evaluate, judging, manifest, metrics, pack, places, rewards, sampling, timeline


def fold(segments, dur):
    """The left-to-right rule in plain Python."""
    kept = sorted(((min(max(s, 0), dur), min(max(e, 0), dur), i) for i, (s, e) in enumerate(segments) if e > s))
    out, prev = [], 0
    for i, (_, e, _) in enumerate(kept):
        end = dur if i == len(kept) - 1 else min(max(e, prev + 1), dur - (len(kept) - 1 - i))
        out.append((prev, end))
        prev = end
    return out or [(0, dur)]


def test_normalize_segments_equals_the_fold(spark):
    rng, rows, videos, want = random.Random(3), [], [], {}
    for v in range(300):
        dur = rng.randint(1, 40)
        seg = [(rng.randint(-5, 45), rng.randint(-5, 50)) for _ in range(rng.randint(0, 6))]
        rows += [(v, i, s, e) for i, (s, e) in enumerate(seg)]
        videos.append((v, dur))
        want[v] = fold(seg, dur)
    s = spark.createDataFrame(rows, "video_id long, pos long, start_ds int, end_ds int")
    got = timeline.normalize_segments(s, spark.createDataFrame(videos, "video_id long, dur_ds int"))
    have = {}
    for r in got.orderBy("video_id", "seg_idx").collect():
        have.setdefault(r.video_id, []).append((r.start_ds, r.end_ds))
    assert have == want


def test_a_video_of_no_length_has_no_segments(spark):
    s = spark.createDataFrame([(1, 0, 0, 5)], "video_id long, pos long, start_ds int, end_ds int")
    assert timeline.normalize_segments(s, spark.createDataFrame([(1, 0)], "video_id long, dur_ds int")).count() == 0


def test_snap_takes_the_earlier_of_two_cuts_and_the_window_is_closed(spark):
    b = spark.createDataFrame([(1, 10), (1, 30), (2, 10)], "video_id long, boundary_ds int")
    c = spark.createDataFrame([(1, 8), (1, 12), (1, 35), (2, 16)], "video_id long, cut_ds int")
    got = {(r.video_id, r.boundary_ds): (r.aligned_ds, r.source, r.delta_ds) for r in timeline.snap_boundaries(b, c).collect()}
    assert got == {(1, 10): (8, "cut", 2), (1, 30): (35, "cut", 5), (2, 10): (10, "original", None)}


def test_merge_is_idempotent_and_appends_new_reasons_only(spark):
    rows = [(1, 0, 0, 5, "Joy", "a b"), (1, 1, 5, 9, "Joy", "b"), (1, 2, 9, 12, "Joy", "c"), (1, 3, 12, 20, "Fear", "")]
    s = spark.createDataFrame(rows, "video_id long, seg_idx int, start_ds int, end_ds int, emotion string, reason string")
    once = timeline.merge_same_emotion(s)
    assert [tuple(r) for r in once.orderBy("seg_idx").collect()] == [(1, 0, 0, 12, "Joy", "a b c", 3), (1, 1, 12, 20, "Fear", "", 1)]
    again = timeline.merge_same_emotion(once.drop("n_merged"))
    assert again.select("start_ds", "end_ds", "reason").collect() == once.select("start_ds", "end_ds", "reason").collect()


def test_phases_without_a_label_stay_apart(spark):
    rows = [(1, 0, 0, 5, "", "x", "p", "r"), (1, 1, 5, 9, "", "y", "q", "s")]
    s = spark.createDataFrame(rows, "video_id long, seg_idx int, start_ds int, end_ds int, emotion string, event string, description string, reason string")
    phases, log = timeline.merge_affect_phases(s)
    assert phases.count() == 2 and log.count() == 0


def test_labels(spark):
    assert (len(EVAL_LABELS), len(PIPELINE_LABELS)) == (27, 28)
    df = spark.createDataFrame([("joy",), ("Joyful",), ("",), (None,), ("Awe",), ("xyz",)], "e string")
    assert [r[0] for r in df.select(match_emotion(F.col("e"))).collect()] == ["Joy", "Joy", "Awkwardness", "Awkwardness", "Awe (or Wonder)", "Interest"]
    pair = spark.createDataFrame([("a b", "B c"), ("", ""), ("a", "")], "a string, b string")
    assert [round(r[0], 3) for r in pair.select(jaccard(token_set(F.col("a")), token_set(F.col("b")))).collect()] == [0.333, 1.0, 0.0]


def test_intervals(spark):
    row = spark.range(1).select(interval_iou(F.lit(0), F.lit(4), F.lit(6), F.lit(10)), interval_iou(F.lit(0), F.lit(4), F.lit(2), F.lit(8)), interval_iou(F.lit(1), F.lit(1), F.lit(1), F.lit(1)), clamp(F.lit(5), F.lit(9), F.lit(7))).first()
    assert tuple(row) == (0.0, 0.25, 0.0, 7)


def test_json_variants(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', 'x {"a": 1} y', "[1]", '{"a": ', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    good = lambda v: [r[0] is not None for r in df.select(extract_json_object(F.col("t"), v)).collect()]
    assert good("pipeline") == [True, True, True, False, False, False, False]
    assert good("evaluation") == [True, True, True, False, False, False, False]
    assert good("strict") == [True, True, False, False, False, False, False]
    assert good("loose") == [True, True, True, False, False, False, False]


def test_last_wins_drops_null_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c")], "k long, o long, v string")
    assert [tuple(r) for r in judging.last_wins(df, ["k"], "o").collect()] == [(1, 2, "b")]


def test_committee_without_judges_scores_zero_and_counts(spark):
    s = spark.createDataFrame([(1, 0), (1, 1)], "video_id long, segment_index int")
    a = spark.createDataFrame([(1, 0, 4.0)], "video_id long, segment_index int, score double")
    c = judging.committee_join(s, a, a.limit(0))
    video, rewrite = judging.committee_video(c, spark.createDataFrame([(1,), (2,)], "video_id long"))
    assert {r.video_id: (r.committee_score, r.failed_indices, r.committee_passed) for r in video.collect()} == {1: (2.0, [1], False), 2: (0.0, [], True)}
    assert rewrite.count() == 1


def test_advantages_of_a_group_sum_to_zero(spark):
    rows = [(p, f"{p}-{i}", i, float((p * 7 + i * 3) % 5), None if i == 1 else 1.0) for p in range(20) for i in range(4)] + [(99, "99-0", 0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "prompt_id long, request_id string, pos long, a double, b double")
    for how in ("grpo", "rloo", "reinforce_plus_plus"):
        out = advantage.group_advantages(df, {"a": 1.0, "b": 0.5}, estimator=how)
        assert out.groupBy("prompt_id").agg(F.abs(F.sum("advantage")).alias("s")).agg(F.max("s")).first()[0] < 1e-6
        assert out.where("prompt_id = 99").first()["advantage"] == 0.0


def test_zero_variance_groups_return_all_when_too_few_remain(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 2.0)], "prompt_id long, pos long, a double")
    assert advantage.drop_zero_variance_groups(df, {"a": 1.0}, 2).count() == 2
    assert advantage.drop_zero_variance_groups(df, {"a": 1.0}, 3).count() == 4


def test_best_of_n_keeps_the_negative_out(spark):
    rows = [(1, 0, "a", 1.0, 0.5), (1, 1, "b", 0.0, 0.5), (1, 2, "c", 1.0, 0.9), (2, 0, "d", 0.0, 0.0), (2, 1, "e", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "query_id long, idx long, choice string, orm double, prm double")
    assert {(r.query_id, r.positive, r.negative) for r in advantage.best_of_n(df, n_best=3).collect()} == {(1, "c", "b"), (1, "a", "b")}


def test_evaluation_of_nothing(spark):
    empty = spark.createDataFrame([], "video_id long, seg_idx int, start_ds int, end_ds int, emotion string")
    pairs = evaluate.match_eval_pairs(empty, empty)
    assert evaluate.eval_overall(pairs).first()["avg_iou"] == 0.0
    assert [r.emotion_accuracy for r in evaluate.eval_by_iou_threshold(pairs).collect()] == [None] * 4


def test_row_index_is_the_global_order(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = sampling.with_row_index(df, ["k"]).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(5000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_split_parts_make_the_whole(spark):
    df = spark.range(1000)
    train, val = sampling.train_val_split(df, 0.3)
    assert train.intersect(val).count() == 0 and train.unionByName(val).count() == 1000 and 200 < val.count() < 400


def test_bins_stay_under_the_limit(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.randint(1, 900)) for i in range(600)], "idx long, length long")
    bins = pack.pack_sequences(df, limit=1000, block=100)
    assert bins.count() == 600
    worst = bins.groupBy("block", "bin").agg(F.sum("length").alias("s")).agg(F.max("s"), F.count("*")).first()
    assert worst[0] <= 1000 and worst[1] < 600


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_text_overlap(spark):
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert metrics._lcs(a, b) == lcs(a, b)
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b", "c d"), ("", "x")], "pred string, ref string")
    got = metrics.text_overlap(df).collect()
    assert len(got) == 2 and (got[0].rouge1, got[0].rougeL) == (1.0, 1.0) and (got[1].rouge1, got[1].bleu4) == (0.0, 0.0)


def test_a_model_that_fails_gives_error_rows(spark, tmp_path):
    def model(frame):
        if (frame["attempt"] == 0).all():
            raise RuntimeError("down")
        assert (frame["last_error"] == "RuntimeError: down").all()
        return [None if i == 1 else "ok" for i in frame["i"]]

    out = annotate.annotate_with(spark.createDataFrame([(0,), (1,)], "i long").coalesce(1), model, f"{tmp_path}/a", retries=1).orderBy("i").collect()
    assert [(r.output, r.error, r.attempts) for r in out] == [("ok", None, 2), (None, "no output", 2)]


def test_rounds_ask_each_row_once_and_lose_none(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(frame):
        import random

        asked.add(len(frame))
        assert all((frame["round"] == 1) == frame["last_output"].isna())
        return [("done" if random.random() < 0.4 else "draft") for _ in frame["i"]]

    rows = spark.range(1000).withColumnRenamed("id", "i").repartition(5)
    out = annotate.annotate_rounds(rows, model, lambda c: c == "done", f"{tmp_path}/rounds", rounds=3)
    for _ in range(2):  # reading again asks nothing again
        got = out.collect()
        assert sorted(r.i for r in got) == list(range(1000))
    assert asked.value == sum(r["round"] for r in got) and all(r.output == "done" or r["round"] == 3 for r in got)
    none = annotate.annotate_rounds(rows.limit(0), model, lambda c: c == "done", f"{tmp_path}/none")
    assert none.count() == 0 and set(none.columns) == {"i", "round", "output", "error", "attempts"}


def test_smoothing_of_a_long_series_equals_the_fold(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.uniform(-5, 5)) for k, n in (("long", 3000), ("short", 3), ("one", 1)) for i in range(n)]
    for smooth in (0.9, 0.5, 0.99):
        got = {(r.k, r.i): r.smoothed for r in metrics.ema_smooth(spark.createDataFrame(rows, "k string, i long, v double"), "k", "i", "v", smooth).collect()}
        at, x, w = None, 0.0, 0.0
        for k, i, v in rows:
            x, w, at = (x * smooth + v, w * smooth + 1, k) if k == at else (v, 1.0, k)
            assert abs(got[k, i] - x / w) < 1e-9
        assert len(got) == len(rows)


def test_samples_of_a_share(spark):
    frame = spark.range(100)
    for n, want in ((0, 0), (7, 7), (100, 100), (250, 250)):
        got = sampling.sample_count(frame, n, id_="id")
        assert got.count() == want and got.select("id", "copy").distinct().count() == want


@pytest.mark.parametrize("ranges", [1, 2, 100])
def test_places_equal_row_number(spark, ranges):
    df = spark.range(20_000).select("id", (F.xxhash64("id") % 500).alias("a"), F.when(F.col("id") % 7 > 0, F.md5((F.col("id") % 90).cast("string").cast("binary"))).alias("b"))
    order = ["b", -F.col("a"), "id"]
    want = df.select("id", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1).alias("want"))
    for parts in (3, 11):  # the places don't depend on the partitions
        got = places.with_row_index(df.repartition(parts), order, ranges=ranges)
        assert got.count() == 20_000 and got.join(want, "id").where("row_idx <> want").count() == 0


def test_places_of_ties_and_of_nothing(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("k"), F.lit("x").alias("row_idx_"))
    got = places.with_row_index(df, ["k"], ranges=50)
    assert sorted(r.row_idx for r in got.collect()) == list(range(9000))
    assert {r.k for r in got.where("row_idx < 3000").collect()} == {0}
    assert places.with_row_index(df.where("false"), ["k"]).collect() == []


def test_prefix_sums_over_four_levels(spark):
    df = spark.range(5000).select("id", (F.xxhash64("id") % 10).alias("v"))
    got = [r.s for r in places.prefix_sums(df, "id", "v", "s", step=8).orderBy("id").collect()]
    values = [r.v for r in df.orderBy("id").collect()]
    assert got == list(itertools.accumulate(values))


def test_ranks_of_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(metrics, "HOT", 3)
    values = [1.0] * 50 + [2.0, 3.0, 3.0] + [float("nan")] * 2
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)], "i long, kind string, value double")
    got = {r.i: r.rank for r in metrics.average_ranks(df).collect()}
    assert [got[i] for i in (0, 49, 50, 51, 52, 53)] == [25.5, 25.5, 51.0, 52.5, 52.5, 54.5] and len(got) == 55


@pytest.mark.parametrize("stop", ["first_exhausted", "all_exhausted"])
def test_interleave_equals_the_draws(spark, stop):
    sizes, probs = [40, 25, 7], [0.5, 0.3, 0.2]
    dfs = [spark.range(n).select((F.col("id") + 1000 * i).alias("id")) for i, n in enumerate(sizes)]
    got = [(r.slot, r.source, r.id) for r in sampling.interleave(dfs, probs, ["id"] * 3, stop=stop, block=16).orderBy("slot").collect()]
    want, taken, slot = [], [0] * 3, 0
    while True:
        x = int(hashlib.md5(f"42-{slot}".encode()).hexdigest()[:8], 16) / 2**32
        s = 0 if x < 0.5 else 1 if x < 0.8 else 2
        if stop == "first_exhausted" and taken[s] == sizes[s]:
            break
        want.append((slot, s, taken[s] % sizes[s] + 1000 * s))
        taken[s], slot = taken[s] + 1, slot + 1
        if stop != "first_exhausted" and all(t >= n for t, n in zip(taken, sizes)):
            break
    assert got == want


def test_annotation_goes_on_where_it_stopped(spark, tmp_path):
    """A run dies half way; the next one asks each request that has no committed output, none twice."""
    log, dead = tmp_path / "asked", tmp_path / "dead"
    dead.write_text("")

    def model(frame):
        import os

        if os.path.exists(dead) and any(i >= 60 and i % 3 == 0 for i in frame["i"]) and os.path.getsize(log) > 150:
            raise SystemExit("the worker is lost")
        with open(log, "a") as f:
            f.writelines(f"{i}\n" for i in frame["i"])
        return [None if i == 7 else f"ok {i}" for i in frame["i"]]

    log.write_text("")
    rows = spark.range(100).withColumnRenamed("id", "i").coalesce(1)
    with pytest.raises(Exception):
        annotate.annotate_with(rows, model, f"{tmp_path}/out", key="i", batches=8, retries=0)
    first = log.read_text().split()
    assert 0 < len(first) < 100
    dead.unlink()
    out = annotate.annotate_with(rows, model, f"{tmp_path}/out", key="i", batches=8, retries=0)
    for _ in range(2):  # reading asks nothing
        got = {r.i: (r.output, r.error) for r in out.collect()}
    asked = log.read_text().split()
    assert got == {i: (None, "no output") if i == 7 else (f"ok {i}", None) for i in range(100)}
    assert all(asked.count(str(i)) == 1 for i in range(100) if i != 7)
    # a later call asks only the one that has no output yet
    annotate.annotate_with(rows, model, f"{tmp_path}/out", key="i", batches=8, retries=0).count()
    assert log.read_text().split()[len(asked):] == ["7"]


def all_pairs(pred, truth, by):
    out = {}
    for r, i, s, e in pred:
        best = None
        for _, j, a, b in sorted(t for t in truth if t[0] == r):
            over, hull = max(0.0, min(e, b) - max(s, a)), max(e, b) - min(s, a)
            score = over if by == "overlap" else over / hull if hull > 0 else 0.0
            if best is None or score > best[0]:
                best = (score, j)
        if best:
            out[r, i] = best[1]
    return out


@pytest.mark.parametrize("by", ["iou", "overlap"])
def test_best_match_equals_all_pairs(spark, by):
    rng = random.Random(5)

    def some(n, r):
        rows = []
        for i in range(n):
            s = round(rng.uniform(-5, 60), rng.choice([0, 1, 3]))
            rows.append((r, i, s, s + rng.choice([0.0, -1.0, 0.0003, 0.5, 1.0, 2.0, 7.0, 50.0, 1e9])))
        return rows

    pred = [x for r in ("a", "b", "c") for x in some(60, r)] + [("none", 0, 0.0, 1.0)]
    truth = [x for r in ("a", "b") for x in some(40, r)] + [("c", 0, 900.0, 901.0), ("c", 1, 0.0, 0.0)]
    ddl = "request_id string, seg_idx long, start double, end double"
    p, t = (spark.createDataFrame(x, ddl).withColumn("emotion", F.lit("joy")) for x in (pred, truth))
    got = {(r.request_id, r.seg_idx): r.t_seg_idx for r in rewards.best_match(p, t, by).collect()}
    assert got == all_pairs(pred, truth, by)


def test_best_match_of_one_long_request(spark):
    n = 20_000
    p = spark.range(n).select(F.lit("r").alias("request_id"), F.col("id").alias("seg_idx"), (F.col("id") * 1.0).alias("start"), (F.col("id") + 1.5).alias("end"), F.lit("joy").alias("emotion"))
    whole = spark.createDataFrame([("r", n, 0.0, float(n), "joy")], "request_id string, seg_idx long, start double, end double, emotion string")
    began = time.perf_counter()
    got = rewards.best_match(p, p.unionByName(whole)).where("seg_idx = t_seg_idx").count()
    assert got == n and time.perf_counter() - began < 60


def test_long_texts_have_a_common_subsequence():
    rng = random.Random(2)
    a, b = ([rng.choice("abcdefgh") for _ in range(20_000)] for _ in range(2))
    began = time.perf_counter()
    assert metrics._lcs(a, b) > 10_000 and time.perf_counter() - began < 5
    assert metrics._lcs([], b) == metrics._lcs(a, []) == 0


def test_sample_of_exactly_k_rows(spark):
    df = spark.range(5000).repartition(7)
    got = [r.id for r in sampling.bottom_k(df, 300).collect()]
    key = lambda i: hashlib.md5(f"{i}-42".encode()).hexdigest()
    assert sorted(got) == sorted(sorted(range(5000), key=key)[:300])
    assert sorted(r.id for r in sampling.bottom_k(df.repartition(3), 300).collect()) == sorted(got)
    assert sampling.bottom_k(df, 5000).count() == 5000 and sampling.bottom_k(df.where("false"), 5).count() == 0


def test_own_negatives(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [(0, e(1, 1), 0), (1, e(1, 0), None), (2, e(1, 0), 1), (3, e(0, 1), 0), (4, e(-1, 0), 0), (5, e(1, 0), None), (6, e(0, 1), None), (7, e(0, 2), 1), (8, e(0, 3), None), (9, e(0, 1), 1), (10, e(1, 1), 0)]
    df = spark.createDataFrame(rows, "pos long, embedding array<double>, label int")
    r = metrics.own_negatives_margin(df).first()
    half = 2**-0.5
    assert (r.mean_pos, r.n_groups) == (1.0, 3) and abs(r.mean_neg - (0 - 1 + half) / 3) < 1e-9 and abs(r.margin - (1 + 1 - half) / 2) < 1e-9
    assert abs(metrics.own_negatives_margin(df, hard_negatives=1).first().mean_neg - half / 2) < 1e-9


def test_truncation_that_raises(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "ids array<int>")
    assert [r.k for r in df.select(tokens.truncate_tokens(F.col("ids"), 3, "raise").alias("k")).collect()] == [[0, 1, 2], []]
    with pytest.raises(Exception, match="a row of 3 tokens is longer than 2"):
        df.select(tokens.truncate_tokens(F.col("ids"), 2, "raise").alias("k")).collect()


def test_terms_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "ab -- a-"), (4, "Zebra zebra -zebra- apple apple mid-way x-y-z it's"), (5, "word " * 60_000 + "other")]
    got = {r.id: r.terms for r in manifest.top_terms(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {4: ["zebra", "apple", "mid-way", "x-y-z"], 5: ["word", "other"]}


def test_rewards_in_rows_equal_those_by_joins(spark):
    rng = random.Random(11)

    def segment():
        s = round(rng.uniform(0, 30), 1)
        return {"start_time": s, "end_time": round(s + rng.choice([-1, 0, 0.2, 1, 5, 40]), 1), "emotion": rng.choice(EVAL_LABELS[:3]), "reason": rng.choice(["", "one two three", "one two four", "else " * 60])}

    requests = [(f"r{i}", json.dumps({"segments": [segment() for _ in range(rng.randint(0, 9))]})) for i in range(60)] + [("bad", "no json"), ("null", None)]
    truth = [(f"r{i}", j, *(lambda s: (s["start_time"], s["end_time"], s["emotion"]))(segment())) for i in range(50) for j in range(rng.randint(1, 8))]
    q = spark.createDataFrame(requests, "request_id string, completion string")
    t = spark.createDataFrame(truth, "request_id string, seg_idx long, start double, end double, emotion string")
    got = {r.request_id: r for r in rewards.score(q, t).collect()}
    pred = rewards.parse_segments(q, "completion")
    assert set(got) == {r for r, _ in requests}
    for name in rewards.WEIGHTS:
        want = {r.request_id: r.reward for r in rewards.REGISTRY[name](q, pred, t).collect()}
        assert want == pytest.approx({i: got[i][name] for i in want}), name
        assert len(set(want.values())) > 1


@pytest.fixture(scope="module")
def run_rows():
    rng, texts = random.Random(11), ["", None, "a", "a b", "b c", "c", "d a b", "long " * 50]
    rows = [(v, i, i, i + 1, rng.choice(["Joy", "Fear", "", None]), f"e{i}", f"d{i}", rng.randrange(len(texts))) for v in range(60) for i in range(rng.randint(1, 9))]
    return texts, rows


@pytest.mark.parametrize("merge", [timeline.merge_same_emotion, lambda *a: timeline.merge_affect_phases(*a)[0]], ids=["same_emotion", "affect_phases"])
def test_merging_by_keys_equals_merging_texts(spark, run_rows, merge):
    texts, rows = run_rows
    keys = spark.createDataFrame(rows, "video_id long, seg_idx int, start_ds int, end_ds int, emotion string, event string, description string, reason long")
    reasons = spark.createDataFrame(list(enumerate(texts)), "key long, reason string")
    told = keys.join(reasons.toDF("k", "t"), F.col("reason") == F.col("k")).withColumn("reason", F.col("t")).drop("k", "t")
    want = merge(told)
    got = sorted(map(tuple, merge(keys, reasons).select(*want.columns).collect()), key=repr)
    assert got == sorted(map(tuple, want.collect()), key=repr) and any(" " in (r[-1 if isinstance(r[-1], str) else -2] or "") for r in got)


def test_segments_carry_what_stands_for_their_reason(spark, sf_dir, tmp_path):
    """Also where doc_id repeats, is null or leaves gaps, and where there are no documents."""
    from tempora.plans import timeline_queries as tq
    from tempora.plans.registry import Inputs

    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    texts = [(0, "x"), (1, "y"), (1, "z"), (3, None), (None, "n"), (9, "w")]
    for docs in (texts, []):
        spark.createDataFrame(docs, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        x = Inputs(spark, str(tmp_path))
        by_key = tq.reasoned(x, tq.key())
        assert by_key.schema["reason"].dataType.simpleString() == "struct<doc_id:bigint,h:bigint>"
        full = by_key.join(tq.reasons(x).withColumnRenamed("reason", "text"), F.col("reason") == F.col("key"))
        plain = tq.reasoned(x, F.md5("text"))
        want = sorted(map(tuple, x.fx_segments.join(x.fx_reasons, "event_id").select("event_id", "seg_idx", "reason").collect()), key=repr) if docs else []
        assert sorted(map(tuple, full.select("event_id", "seg_idx", "text").collect()), key=repr) == want
        md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
        assert sorted(map(tuple, plain.select("event_id", "seg_idx", "reason").collect()), key=repr) == sorted(((e, i, md5(t)) for e, i, t in want), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_repetition_penalty_splits_a_text_once(spark, n):
    rng = random.Random(5)
    texts = ["", None, " a ", "a b", "A a\ta", "a b c\n", "x y x y x y x y "] + [" ".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(60)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.repetition_penalty(F.col("t"), n).alias("r"))

    def plain(text):
        words = text.lower().split()
        grams = list(zip(*(words[k:] for k in range(n)), strict=False))
        return -(1 - len(set(grams)) / len(grams)) if grams else 0.0

    for t, r in out.collect():
        assert r is None if t is None else abs(r - plain(t)) < 1e-12
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_best_of_n_sorts_a_query_once(spark):
    """Against plain Python, with ties, missing choices and a null query; the rows aren't read again for the worst."""
    rng, rows = random.Random(9), []
    for q in [*range(120), None]:
        rows += [(q, i, rng.choice([None, f"{q}-{i}", f"{q}-{i}"]), rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.2, 1.0])) for i in range(rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "query_id long, idx long, choice string, orm double, prm double")

    def plain(n_best, threshold, easy, n_samples):
        def normal(values):
            low, high = min(values), max(values)
            return [min(1.0, low) if low == high else (v - low) / (high - low + 1e-5) for v in values]

        out = []
        for q in range(120):
            own = [r for r in rows if r[0] == q]
            o, p = normal([r[3] for r in own]), normal([r[4] for r in own])
            ok = [threshold is None or (r[3] > threshold and r[4] > threshold) for r in own]
            if not any(ok) or easy is not None and sum(v > 0 for v in o) - 1 >= int(n_samples * easy):
                continue
            ranked = sorted(range(len(own)), key=lambda i: (p[i] + 10 * o[i], own[i][1]), reverse=True)
            out += [(q, own[i][1], own[i][2], round(p[i] + 10 * o[i], 6), own[ranked[-1]][2]) for i in ranked[:n_best] if ok[i] and i != ranked[-1]]
        return sorted(out, key=repr)

    for how in ((2, 0.0, None, None), (5, None, None, None), (3, 0.1, 0.5, 8)):
        got = advantage.best_of_n(df, n_best=how[0], threshold=how[1], easy=how[2], n_samples=how[3])
        assert sorted(((r.query_id, r.idx, r.positive, round(r.score, 6), r.negative) for r in got.collect()), key=repr) == plain(*how)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("DESC") and sum("ASC" in line and "Window" in line for line in plan.splitlines()) == 0
