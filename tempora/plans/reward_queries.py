"""Queries on rewards, judges, advantages and preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import extract_json_object
from ..functions.labels import EVAL_LABELS
from ..operators import advantage as adv
from ..operators import judging as jd
from ..operators import rewards as rw
from .registry import Inputs, query, rounded

WEIGHTS = {"r_struct": 0.5, "r_count": 0.3, "r_emotion": 0.2}
_LABELS = "[" + ", ".join(f"'{x}'" for x in EVAL_LABELS) + "]"
#: Predicted and true segments with times in seconds: p and g.
SIDES = """
    p AS (SELECT CAST(video_id AS VARCHAR) AS request_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ds, event_id) - 1 AS i, greatest(start_ds, 0) / 10.0 AS s, greatest(end_ds, 0) / 10.0 AS e, emotion,
            emotion || ' felt at ' || greatest(start_ds, 0) AS reason, greatest(start_ds, 0) AS sd, greatest(end_ds, 0) AS ed FROM fx_pred_raw),
    g AS (SELECT CAST(video_id AS VARCHAR) AS request_id, seg_idx AS i, start_ds / 10.0 AS s, end_ds / 10.0 AS e, emotion, start_ds AS sd, end_ds AS ed FROM fx_segments),
    rq AS (SELECT DISTINCT request_id FROM p),
    ct AS (SELECT request_id, '{"segments": [' || string_agg('{"start_time": ' || (sd // 10) || '.' || (sd % 10) || ', "end_time": ' || (ed // 10) || '.' || (ed % 10) || ', "emotion": "' || emotion || '", "reason": "' || reason || '"}', ', ' ORDER BY i) || ']}' AS completion FROM p GROUP BY request_id),
    hull AS (SELECT p.request_id, p.i, p.s, p.e, p.emotion, g.i AS gi, g.s AS gs, g.e AS ge, g.emotion AS gem, greatest(0, least(p.e, g.e) - greatest(p.s, g.s)) AS ov,
               CASE WHEN greatest(p.e, g.e) - least(p.s, g.s) > 0 THEN greatest(0, least(p.e, g.e) - greatest(p.s, g.s)) / (greatest(p.e, g.e) - least(p.s, g.s)) ELSE 0 END AS iou FROM p JOIN g ON p.request_id = g.request_id),
    bi AS (SELECT * FROM hull QUALIFY row_number() OVER (PARTITION BY request_id, i ORDER BY iou DESC, gi) = 1),
    bo AS (SELECT * FROM hull QUALIFY row_number() OVER (PARTITION BY request_id, i ORDER BY ov DESC, gi) = 1),
    r_temporal AS (SELECT request_id, avg(0.5 * iou + 0.5 * exp(-(abs(s - gs) + abs(e - ge)) / 0.5)) AS reward FROM bi GROUP BY request_id),
    r_emotion AS (SELECT request_id, avg(CASE WHEN emotion = gem AND iou > 0.5 THEN 1.0 ELSE 0.0 END) AS reward FROM bo GROUP BY request_id),
    r_count AS (SELECT a.request_id, exp(-abs(a.n - b.n) / 1.5) AS reward FROM (SELECT request_id, COUNT(*) AS n FROM p GROUP BY ALL) a JOIN (SELECT request_id, COUNT(*) AS n FROM g GROUP BY ALL) b ON a.request_id = b.request_id),"""
STRUCTURE = f"""
    ck AS (SELECT request_id, i, ed, ed > sd AND sd = COALESCE(lag(ed) OVER w, 0) AND list_contains({_LABELS}, emotion) AND COALESCE(lag(emotion) OVER w <> emotion, true) AS ok FROM p WINDOW w AS (PARTITION BY request_id ORDER BY i)),
    va AS (SELECT c.request_id, bool_and(ok) AND COALESCE(arg_max(c.ed, c.i) = any_value(t.ed), true) AS valid FROM ck c LEFT JOIN (SELECT request_id, arg_max(ed, i) AS ed FROM g GROUP BY ALL) t ON c.request_id = t.request_id GROUP BY c.request_id),
    lo AS (SELECT request_id, bool_and(e - s >= 0.4) AS l FROM p GROUP BY ALL),
    wc AS (SELECT request_id, len(regexp_extract_all(completion, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS n FROM ct),
    r_structure AS (SELECT wc.request_id, 0.5 * CAST(valid AS INT) + 0.2 * CAST(l AS INT) + 0.3 * CASE WHEN n >= 2400 THEN 0 ELSE exp(-greatest(0, n - 1200) / 400.0) END AS reward
                    FROM wc JOIN va ON wc.request_id = va.request_id JOIN lo ON wc.request_id = lo.request_id),"""
REASON = """
    rt AS (SELECT request_id, i, list_distinct(regexp_extract_all(lower(reason), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS t, len(regexp_extract_all(reason, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS n FROM p),
    rj AS (SELECT request_id, n, t, lag(t) OVER (PARTITION BY request_id ORDER BY i) AS u FROM rt),
    r_reason AS (SELECT request_id, avg(CASE WHEN u IS NOT NULL AND len(list_intersect(t, u)) > 0.75 * len(list_distinct(list_concat(t, u))) THEN 0 ELSE exp(-abs(n - 120) / 40.0) END) AS reward FROM rj GROUP BY ALL)"""


def sides(x: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests with JSON completions, parsed predictions, and the truth; a video is a request."""
    tenth = lambda c: F.concat((F.col(c) / 10).cast("int").cast("string"), F.lit("."), (F.col(c) % 10).cast("string"))
    p = x.fx_pred_raw.withColumns({"s": F.greatest("start_ds", F.lit(0)), "e": F.greatest("end_ds", F.lit(0))})
    text = F.format_string('{"start_time": %s, "end_time": %s, "emotion": "%s", "reason": "%s felt at %d"}', tenth("s"), tenth("e"), "emotion", "emotion", "s")
    rows = p.groupBy(F.col("video_id").cast("string").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("start_ds", "event_id", text.alias("t")))).alias("a"))
    requests = rows.select("request_id", F.concat(F.lit('{"segments": ['), F.array_join("a.t", ", "), F.lit("]}")).alias("completion"))
    truth = x.fx_segments.select(F.col("video_id").cast("string").alias("request_id"), F.col("seg_idx").cast("long"), (F.col("start_ds") / 10).alias("start"), (F.col("end_ds") / 10).alias("end"), "emotion")
    return requests, rw.parse_segments(requests, "completion"), truth


def _sql(name: str) -> str:
    return f"WITH {SIDES}{STRUCTURE}{REASON} SELECT rq.request_id, round(least(1, greatest(0, COALESCE(reward, 0))), 6) AS reward FROM rq LEFT JOIN r_{name} r ON rq.request_id = r.request_id"


def _register(name: str):
    def f(x: Inputs) -> DataFrame:
        return rounded(rw.REGISTRY[name](*sides(x)), "reward")

    f.__name__ = f"reward_{name}"
    return query(_sql(name))(f)


reward_structure, reward_count, reward_temporal, reward_emotion, reward_reason = map(_register, rw.WEIGHTS)


@query(
    f"WITH {SIDES}{STRUCTURE}{REASON} SELECT rq.request_id, round(0.10 * COALESCE(a.reward, 0) + 0.25 * COALESCE(b.reward, 0) + 0.25 * COALESCE(c.reward, 0) + 0.25 * COALESCE(d.reward, 0) + 0.15 * COALESCE(e.reward, 0), 6) AS reward "
    + "FROM rq " + " ".join(f"LEFT JOIN r_{n} {t} ON rq.request_id = {t}.request_id" for n, t in zip(rw.WEIGHTS, "abcde", strict=True))
)
def weighted_reward(x: Inputs) -> DataFrame:
    requests, _, truth = sides(x)
    return rounded(rw.score(requests, truth).select("request_id", rw.weighted_reward(None, rw.WEIGHTS).alias("reward")), "reward")


@query(f"WITH {SIDES[:-1]} SELECT request_id, CAST(i AS BIGINT) AS seg_idx, CAST(gi AS BIGINT) AS t_seg_idx, round(iou, 6) AS iou FROM bi")
def best_match_by_iou(x: Inputs) -> DataFrame:
    _, pred, truth = sides(x)
    return rounded(rw.best_match(pred, truth).select("request_id", "seg_idx", "t_seg_idx", "iou"), "iou")


@query(f"WITH {SIDES[:-1]} SELECT request_id, CAST(i AS BIGINT) AS seg_idx, CAST(gi AS BIGINT) AS t_seg_idx, round(iou, 6) AS iou FROM bo")
def best_match_by_overlap(x: Inputs) -> DataFrame:
    _, pred, truth = sides(x)
    return rounded(rw.best_match(pred, truth, "overlap").select("request_id", "seg_idx", "t_seg_idx", "iou"), "iou")


_FENCE = "'```json' || chr(10) || o || chr(10) || '```'"


@query(
    """WITH o AS (SELECT event_id, '{"start_time": ' || start_ds || ', "emotion": "' || emotion || '"}' AS o FROM fx_segments)
    SELECT event_id, CASE WHEN event_id % 6 IN (3, 4) THEN NULL ELSE o END AS pipeline, CASE WHEN event_id % 6 = 4 THEN NULL ELSE o END AS evaluation, CASE WHEN event_id % 6 IN (0, 1, 5) THEN o END AS strict FROM o"""
)
def extract_json_object_query(x: Inputs) -> DataFrame:
    o = F.format_string('{"start_time": %d, "emotion": "%s"}', "start_ds", "emotion")
    kind = F.col("event_id") % 6
    text = F.when(kind == 1, F.concat(F.lit("```json\n"), o, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), o, F.lit(" done"))).when(kind == 3, F.concat(F.lit("["), o, F.lit("]")))
    text = text.when(kind == 4, F.substring(o, 1, 12)).when(kind == 5, F.concat(F.lit("\n "), o, F.lit("\n"))).otherwise(o)
    rows = x.fx_segments.select("event_id", text.alias("t"))
    strip = lambda v: F.trim(F.regexp_replace(extract_json_object(F.col("t"), v), r"\A\s+|\s+\z", ""))
    pipeline = F.when(kind != 3, strip("pipeline"))
    return rows.select("event_id", pipeline.alias("pipeline"), strip("evaluation").alias("evaluation"), strip("strict").alias("strict"))


# --- judges -----------------------------------------------------------------------------------
_SCORE = "COALESCE(nullif(average_score, 0), (visual_grounding + causal_logic + viewer_centricity + temporal_consistency + answer_consistency) / 5.0)"


@query(f"SELECT judge, video_id, segment_index, round({_SCORE}, 6) AS score, {_SCORE} >= 3.5 AS segment_passed FROM fx_judgements")
def judge_segments(x: Inputs) -> DataFrame:
    return rounded(jd.judge_scores(x.fx_judgements)[0].select("judge", "video_id", "segment_index", "score", "segment_passed"), "score")


@query(f"SELECT judge, video_id, round(avg({_SCORE}), 6) AS average_score, bool_and({_SCORE} >= 3.5) AS passed, COUNT(*) AS n_segments FROM fx_judgements GROUP BY judge, video_id")
def judge_scores(x: Inputs) -> DataFrame:
    return rounded(jd.judge_scores(x.fx_judgements)[1], "average_score")


_COMMITTEE = f"""j AS (SELECT judge, video_id, segment_index, {_SCORE} AS score FROM fx_judgements QUALIFY row_number() OVER (PARTITION BY judge, video_id, segment_index ORDER BY pos DESC) = 1),
    cm AS (SELECT s.video_id, s.seg_idx AS segment_index, COALESCE((COALESCE(a.score, 0) + COALESCE(b.score, 0)) / nullif(CAST(a.score IS NOT NULL AS INT) + CAST(b.score IS NOT NULL AS INT), 0), 0) AS committee_score,
             CAST(a.score IS NOT NULL AS INT) + CAST(b.score IS NOT NULL AS INT) AS n_judges
           FROM fx_segments s LEFT JOIN (SELECT * FROM j WHERE judge = 'a') a ON a.video_id = s.video_id AND a.segment_index = s.seg_idx LEFT JOIN (SELECT * FROM j WHERE judge = 'b') b ON b.video_id = s.video_id AND b.segment_index = s.seg_idx)"""


def _committee(x: Inputs) -> DataFrame:
    scored = jd.last_wins(jd.judge_scores(x.fx_judgements)[0], ["judge", "video_id", "segment_index"], "pos")
    segments = x.fx_segments.select("video_id", F.col("seg_idx").alias("segment_index"))
    return jd.committee_join(segments, scored.where("judge = 'a'"), scored.where("judge = 'b'"))


@query(f"WITH {_COMMITTEE} SELECT video_id, segment_index, n_judges, round(committee_score, 6) AS committee_score, n_judges > 0 AND committee_score >= 3.5 AS passed FROM cm")
def committee_join(x: Inputs) -> DataFrame:
    return rounded(_committee(x).select("video_id", "segment_index", "n_judges", "committee_score", "passed"), "committee_score")


@query(
    f"""WITH {_COMMITTEE}, s AS (SELECT video_id, avg(committee_score) AS c, COUNT(*) AS n, string_agg(CASE WHEN NOT (n_judges > 0 AND committee_score >= 3.5) THEN segment_index END, ',' ORDER BY segment_index) AS failed FROM cm GROUP BY video_id)
    SELECT v.video_id, round(COALESCE(c, 0), 6) AS committee_score, COALESCE(n, 0) AS n_segments, COALESCE(failed, '') AS failed_indices, failed IS NULL AS committee_passed FROM fx_videos v LEFT JOIN s ON v.video_id = s.video_id"""
)
def committee_video(x: Inputs) -> DataFrame:
    out = jd.committee_video(_committee(x), x.fx_videos)[0]
    return rounded(out.withColumn("failed_indices", F.array_join(F.transform("failed_indices", lambda i: i.cast("string")), ",")), "committee_score")


@query(f"WITH {_COMMITTEE} SELECT video_id, segment_index, round(committee_score, 6) AS committee_score, '' AS suggestions FROM cm WHERE NOT (n_judges > 0 AND committee_score >= 3.5)")
def rewrite_manifest(x: Inputs) -> DataFrame:
    return rounded(jd.committee_video(_committee(x), x.fx_videos)[1], "committee_score")


@query("SELECT judge, video_id, segment_index, pos FROM fx_judgements QUALIFY row_number() OVER (PARTITION BY video_id, segment_index ORDER BY pos DESC, judge DESC) = 1")
def last_wins(x: Inputs) -> DataFrame:
    rows = x.fx_judgements.withColumn("o", F.struct("pos", "judge"))
    return jd.last_wins(rows.select("judge", "video_id", "segment_index", "pos", "o"), ["video_id", "segment_index"], "o").drop("o")


@query("SELECT video_id, dur_ds FROM fx_videos WHERE video_id % 4 <> 0")
def pending_only(x: Inputs) -> DataFrame:
    return jd.pending_only(x.fx_videos.select("video_id", "dur_ds"), x.fx_videos.where("video_id % 4 = 0"))


@query("WITH c AS (SELECT prompt_id, COUNT(*) AS n FROM fx_rollouts GROUP BY ALL) SELECT o_orderkey AS id, string_agg(request_id, ',' ORDER BY pos, request_id) AS choices FROM orders JOIN c ON o_orderkey = prompt_id JOIN fx_rollouts r ON r.prompt_id = o_orderkey WHERE n = 4 GROUP BY o_orderkey")
def reuse_cached_choices(x: Inputs) -> DataFrame:
    cache = x.fx_rollouts.select(F.col("prompt_id").alias("id"), F.col("request_id").alias("choice"), "pos")
    return jd.reuse_cached_choices(x.orders.select(F.col("o_orderkey").alias("id")), cache, 4)[0].select("id", F.array_join("choices", ",").alias("choices"))


# --- advantages -------------------------------------------------------------------------------
_REWARD = "0.5 * r_struct + 0.3 * COALESCE(r_count, 0) + 0.2 * r_emotion"
_DEV = "CASE WHEN COUNT({0}) OVER w > 1 THEN stddev_samp({0}) OVER w ELSE 0 END"
_ROWS = f"rr AS (SELECT *, {_REWARD} AS reward FROM fx_rollouts), ce AS (SELECT *, reward - avg(reward) OVER w AS c, COUNT(*) OVER w AS k, {_DEV.format('reward')} AS dev, stddev_samp(reward) OVER () AS all_dev FROM rr WINDOW w AS (PARTITION BY prompt_id))"
_SELECT = "SELECT prompt_id, request_id, pos, round(reward, 6) AS reward, round({0}, 5) AS advantage FROM {1}"


def _advantages(x: Inputs, **how: str) -> DataFrame:
    out = adv.group_advantages(x.fx_rollouts, WEIGHTS, **how)
    return rounded(out, "reward").select("prompt_id", "request_id", "pos", "reward", F.round("advantage", 5).alias("advantage"))


@query(f"WITH {_ROWS} " + _SELECT.format("c / (dev + 0.0001)", "ce"))
def group_advantages_grpo(x: Inputs) -> DataFrame:
    return _advantages(x)


@query(f"WITH {_ROWS} " + _SELECT.format("c", "ce"))
def group_advantages_none(x: Inputs) -> DataFrame:
    return _advantages(x, scale="none")


@query(f"WITH {_ROWS} " + _SELECT.format("c / (all_dev + 0.0001)", "ce"))
def group_advantages_batch(x: Inputs) -> DataFrame:
    return _advantages(x, scale="batch")


_RLOO = "CASE WHEN k > 1 THEN c * k / (k - 1) ELSE c END"


@query(f"WITH {_ROWS} " + _SELECT.format(f"{_RLOO} / (dev + 0.0001)", "ce"))
def group_advantages_rloo(x: Inputs) -> DataFrame:
    return _advantages(x, estimator="rloo")


@query(f"WITH {_ROWS}, d AS (SELECT *, {_DEV.format('c')} AS cd FROM ce WINDOW w AS (PARTITION BY prompt_id)) " + _SELECT.format("c / (cd + 0.0001)", "d"))
def group_advantages_reinforce(x: Inputs) -> DataFrame:
    return _advantages(x, estimator="reinforce_plus_plus")


@query(f"WITH {_ROWS}, d AS (SELECT *, stddev_samp(c) OVER () AS cd FROM ce) " + _SELECT.format("c / (cd + 0.0001)", "d"))
def group_advantages_reinforce_batch(x: Inputs) -> DataFrame:
    return _advantages(x, estimator="reinforce_plus_plus", scale="batch")


@query(
    "WITH z AS (SELECT prompt_id, request_id, pos, " + _REWARD + " AS reward, "
    + " + ".join(f"{w} * ({c} - avg({c}) OVER w) / ({_DEV.format(c)} + 0.00000001)" for c, w in WEIGHTS.items())
    + " AS s FROM fx_rollouts WINDOW w AS (PARTITION BY prompt_id)), m AS (SELECT avg(s) AS a, stddev_samp(s) AS d FROM z) "
    + "SELECT prompt_id, request_id, pos, round(reward, 6) AS reward, round((s - a) / (d + 0.00000001), 5) AS advantage FROM z, m"
)
def group_advantages_gdpo(x: Inputs) -> DataFrame:
    return _advantages(x, scale="gdpo")


_LAST = f"""rr AS (SELECT *, {_REWARD} AS reward FROM fx_rollouts), la AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pos DESC, reward DESC) = 1),
    ce AS (SELECT *, reward - avg(reward) OVER w AS c, {_DEV.format('reward')} AS dev FROM la WINDOW w AS (PARTITION BY prompt_id)),
    sp AS (SELECT request_id, MAX(reward) - MIN(reward) <= 0.000001 AS consistent FROM rr GROUP BY ALL)"""


@query(f"WITH {_LAST} SELECT rr.prompt_id, rr.request_id, rr.pos, round(ce.reward, 6) AS reward, round(c / (dev + 0.0001), 5) AS advantage, consistent FROM rr JOIN ce ON rr.request_id = ce.request_id JOIN sp ON sp.request_id = rr.request_id")
def request_advantages(x: Inputs) -> DataFrame:
    out = adv.request_advantages(x.fx_rollouts, WEIGHTS)
    return rounded(out, "reward").select("prompt_id", "request_id", "pos", "reward", F.round("advantage", 5).alias("advantage"), "consistent")


@query(f"WITH {_ROWS} SELECT prompt_id, request_id, pos FROM ce WHERE dev > 0 ORDER BY prompt_id, pos, request_id LIMIT 1000")
def drop_zero_variance_groups(x: Inputs) -> DataFrame:
    out = adv.drop_zero_variance_groups(x.fx_rollouts, WEIGHTS, 1000, order=("prompt_id", "pos", "request_id"))
    return out.select("prompt_id", "request_id", "pos")


@query(
    f"""WITH {_ROWS}, g AS (SELECT prompt_id, avg(reward) AS m, CASE WHEN COUNT(*) > 1 THEN stddev_samp(reward) ELSE 0 END AS d FROM rr GROUP BY ALL)
    SELECT round(avg(m), 6) AS reward, round(avg(d), 6) AS reward_std, round(avg(CASE WHEN abs(d) <= 0.00000001 THEN 1.0 ELSE 0.0 END), 6) AS frac_reward_zero_std,
    """ + ", ".join(f"(SELECT round(avg({c}), 6) FROM fx_rollouts) AS {c}_mean, (SELECT round(stddev_samp({c}), 6) FROM fx_rollouts) AS {c}_std" for c in WEIGHTS) + " FROM g"
)
def reward_stats(x: Inputs) -> DataFrame:
    out = adv.reward_stats(x.fx_rollouts, WEIGHTS)
    return rounded(out, *out.columns)


_CAND = "ca AS (SELECT prompt_id AS query_id, row_number() OVER (PARTITION BY prompt_id ORDER BY pos, request_id, r_emotion) - 1 AS idx, request_id AS choice, r_struct AS orm, COALESCE(r_count, 0) AS prm FROM fx_rollouts)"


def _candidates(x: Inputs) -> DataFrame:
    order = "row_number() OVER (PARTITION BY prompt_id ORDER BY pos, request_id, r_emotion) - 1 AS idx"
    return x.fx_rollouts.selectExpr("prompt_id AS query_id", order, "request_id AS choice", "r_struct AS orm", "COALESCE(r_count, 0) AS prm")


@query(
    f"""WITH {_CAND}, no AS (SELECT *, CASE WHEN MIN(orm) OVER w = MAX(orm) OVER w THEN least(1, MIN(orm) OVER w) ELSE (orm - MIN(orm) OVER w) / (MAX(orm) OVER w - MIN(orm) OVER w + 0.00001) END AS o,
      CASE WHEN MIN(prm) OVER w = MAX(prm) OVER w THEN least(1, MIN(prm) OVER w) ELSE (prm - MIN(prm) OVER w) / (MAX(prm) OVER w - MIN(prm) OVER w + 0.00001) END AS p, orm > 0 AND prm > 0 AS ok FROM ca WINDOW w AS (PARTITION BY query_id)),
    sc AS (SELECT *, p + 10 * o AS score FROM no),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx DESC) AS r, row_number() OVER (PARTITION BY query_id ORDER BY score, idx) AS wr, bool_or(ok) OVER (PARTITION BY query_id) AS anyok FROM sc)
    SELECT t.query_id, CAST(t.idx AS BIGINT) AS idx, t.choice AS positive, w.choice AS negative, round(t.score, 6) AS score FROM rk t JOIN rk w ON t.query_id = w.query_id AND w.wr = 1 WHERE t.anyok AND t.r <= 2 AND t.ok AND t.wr <> 1"""
)
def best_of_n(x: Inputs) -> DataFrame:
    out = adv.best_of_n(_candidates(x), n_best=2)
    return rounded(out.select("query_id", F.col("idx").cast("long"), "positive", "negative", "score"), "score")
