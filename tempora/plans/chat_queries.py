"""Queries on conversations, requests, answers, files and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat as ch
from ..functions import tokens as tk
from ..functions.intervals import clamp
from ..operators import advantage as adv
from ..operators import annotate as an
from ..operators import evaluate as ev
from ..operators import prepare as pr
from ..operators import rewards as rw
from ..operators import sampling as sp
from ..operators.judging import last_wins
from ..sources import files as io
from ..sources.shared import shared_folder
from ..streaming import jobs
from .registry import Inputs, query, rounded
from .reward_queries import SIDES, sides
from .timeline_queries import PAIRS, pairs

def scratch(x: Inputs, name: str) -> str:
    return shared_folder(x.spark, name)


def conversations(x: Inputs) -> DataFrame:
    """conv_id, messages: array of (role, content) by turn."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    g = x.fx_messages.groupBy("conv_id").agg(parts.alias("p"))
    return g.select("conv_id", F.transform("p", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


_M = "ms AS (SELECT *, MAX(turn) OVER (PARTITION BY conv_id) AS fin, MAX(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS lu FROM fx_messages)"


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


@query("SELECT conv_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) ORDER BY turn)) AS text_md5 FROM fx_messages WHERE content <> '' GROUP BY conv_id")
def dialogue_text(x: Inputs) -> DataFrame:
    return conversations(x).select("conv_id", _md5(ch.dialogue_text(F.col("messages"))).alias("text_md5"))


@query(f"WITH {_M} SELECT conv_id, COUNT(*) FILTER (WHERE turn < fin OR role <> 'assistant') AS n_messages, MAX(CASE WHEN turn = fin AND role = 'assistant' THEN md5(content) END) AS label_md5 FROM ms GROUP BY conv_id")
def split_last_answer(x: Inputs) -> DataFrame:
    m, label = ch.split_last_answer(F.col("messages"))
    return conversations(x).select("conv_id", F.size(m).cast("long").alias("n_messages"), _md5(label).alias("label_md5"))


@query(f"WITH {_M} SELECT conv_id, COUNT(*) FILTER (WHERE turn <= lu) + 1 AS n_messages, md5(string_agg(content, '|' ORDER BY turn) FILTER (WHERE turn <= lu) || '|no') AS rejected_md5 FROM ms GROUP BY conv_id")
def build_rejected(x: Inputs) -> DataFrame:
    r = conversations(x).withColumn("r", ch.build_rejected(F.col("messages"), F.lit("no")))
    return r.select("conv_id", F.size("r").cast("long").alias("n_messages"), _md5(F.array_join(F.transform("r", lambda m: m["content"]), "|")).alias("rejected_md5"))


@query(
    """WITH s AS (SELECT *, MIN(turn) OVER w AS t0, arg_min(role, turn) OVER w = 'system' AS sys FROM fx_messages WINDOW w AS (PARTITION BY conv_id)),
    r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM s WHERE NOT (sys AND turn = t0))
    SELECT c.conv_id, any_value(has) AS has_system, CAST(CEIL(COUNT(i) / 2.0) AS BIGINT) AS n_rounds, COALESCE(bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END), true) AS valid
    FROM (SELECT conv_id, bool_or(sys) AS has FROM s GROUP BY ALL) c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id"""
)
def to_history(x: Inputs) -> DataFrame:
    h = conversations(x).withColumn("h", ch.to_history(F.col("messages")))
    return h.select("conv_id", F.col("h.system").isNotNull().alias("has_system"), F.size("h.history").cast("long").alias("n_rounds"), F.col("h.valid").alias("valid"))


@query("SELECT conv_id, turn, md5('<image>' || content || '<video>') AS text_md5, CAST(1 AS BIGINT) AS n_images, CAST(1 AS BIGINT) AS n_videos FROM fx_messages")
def flatten_content_parts(x: Inputs) -> DataFrame:
    part = lambda t, text, path: F.struct(F.lit(t).alias("type"), text.alias("text"), path.alias("path"))
    none = F.lit(None).cast("string")
    parts = F.array(part("image", none, F.lit("a.png")), part("text", F.col("content"), none), part("video", none, F.lit("b.mp4")))
    f = x.fx_messages.withColumn("f", ch.flatten_content_parts(parts))
    return f.select("conv_id", "turn", _md5(F.col("f.text")).alias("text_md5"), F.size("f.images").cast("long").alias("n_images"), F.size("f.videos").cast("long").alias("n_videos"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round((event_id % 11) / 10.0, 1) END AS bounded, CASE WHEN event_id % 3 = 0 THEN round((event_id % 11) / 10.0, 1) WHEN event_id % 3 = 1 THEN 7.5 ELSE 0 END AS \"float\" FROM events")
def parse_reward_text(x: Inputs) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.format_string("Good.\nReward: %.1f", k % 11 / 10)).when(k % 3 == 1, "Reward: 7.5").otherwise("Reward: none")
    rows = x.events.select("event_id", text.alias("t"))
    return rows.select("event_id", ch.parse_reward_text(F.col("t")).alias("bounded"), ch.parse_reward_text(F.col("t"), "float").alias("float"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'look' WHEN event_id % 3 = 1 THEN 'find' END AS name, CASE WHEN event_id % 3 = 0 THEN '{\"k\":' || event_id || '}' WHEN event_id % 3 = 1 THEN 'item ' || event_id END AS arguments FROM events")
def extract_tool_calls(x: Inputs) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.format_string('Let me.\n<tool_call>\n{"name": "look", "arguments": {"k":%d}}\n</tool_call>', k)).when(k % 3 == 1, F.format_string("Thought: so\nAction: find\nAction Input: item %d\nObservation: none", k)).otherwise("nothing")
    c = x.events.select("event_id", ch.extract_tool_calls(text).alias("c"))
    return c.select("event_id", F.get("c", F.lit(0))["name"].alias("name"), F.get("c", F.lit(0))["arguments"].alias("arguments"))


@query(f"WITH {_M} SELECT conv_id, CAST(SUM(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS DOUBLE) AS w_default, CAST(SUM(CASE WHEN role = 'assistant' AND turn > lu THEN 1 ELSE 0 END) AS DOUBLE) AS w_last, CAST(COUNT(*) AS DOUBLE) AS w_all FROM ms GROUP BY conv_id")
def loss_weights(x: Inputs) -> DataFrame:
    total = lambda s: F.aggregate(ch.loss_weights(F.col("messages"), s), F.lit(0.0), lambda a, w: a + w)
    return conversations(x).select("conv_id", total("default").alias("w_default"), total("last_round").alias("w_last"), total("all").alias("w_all"))


@query("SELECT event_id, 'Thought:|1.0;so |1.0;Action:|2.0;find ' || event_id || '|3.0' AS parts FROM events")
def span_weights(x: Inputs) -> DataFrame:
    text = F.format_string("Thought:so Action:find %d", "event_id")
    s = ch.span_weights(text, {"Thought:": (1.0, 1.0), "Action:": (2.0, 3.0)})
    return x.events.select("event_id", F.array_join(F.transform(s, lambda p: F.concat_ws("|", p["text"], p["weight"].cast("string"))), ";").alias("parts"))


@query(
    """WITH a AS (SELECT *, CASE WHEN turn % 4 IN (2, 3) THEN 'tool_call' ELSE role END AS kind FROM fx_messages), b AS (SELECT *, CASE WHEN kind = 'tool_call' AND lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) = 'tool_call' THEN 0 ELSE 1 END AS n FROM a),
    c AS (SELECT *, SUM(n) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM b) SELECT conv_id, CAST(i - 1 AS BIGINT) AS idx, CASE WHEN MIN(kind) = 'tool_call' THEN 'assistant' ELSE MIN(kind) END AS role, COUNT(*) AS n, md5(string_agg(content, '' ORDER BY turn)) AS content_md5 FROM c GROUP BY conv_id, i"""
)
def merge_consecutive_tool_calls(x: Inputs) -> DataFrame:
    kinds = x.fx_messages.withColumn("role", F.when((F.col("turn") % 4).isin(2, 3), "tool_call").otherwise(F.col("role")))
    return pr.merge_consecutive_tool_calls(kinds).select("conv_id", "idx", "role", "n", _md5(F.col("content")).alias("content_md5"))


# --- rewards of texts ---------------------------------------------------------------------------
@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS answer, CASE WHEN event_id % 4 = 1 THEN CAST(1 AS DOUBLE) ELSE 0 END AS react FROM events")
def format_match(x: Inputs) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, "<think>a\nb</think>\n<answer>c</answer>").when(k == 1, "<think>a</think> Action: x\nAction Input: y").when(k == 2, "<think>a</think><answer>c</answer> more").otherwise("none")
    return x.events.select("event_id", tk.format_match(text).alias("answer"), tk.format_match(text, "react").alias("react"))


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda q: q <> '') AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g, len(w) AS n FROM w) SELECT doc_id, round(CASE WHEN n < 3 THEN 0 ELSE -(1 - len(list_distinct(g)) / len(g)) END, 6) AS reward FROM g")
def repetition_penalty(x: Inputs) -> DataFrame:
    return rounded(x.documents.select("doc_id", tk.repetition_penalty(F.col("text")).alias("reward")), "reward")


@query("SELECT idx, round(least(-(length - (1024 - 256)) / 256.0, 0), 6) AS reward FROM fx_lengths")
def overlong_penalty(x: Inputs) -> DataFrame:
    return rounded(x.fx_lengths.select("idx", tk.overlong_penalty(F.col("length"), 1024, 256).alias("reward")), "reward")


@query("SELECT idx, round(CASE WHEN idx % 2 = 0 THEN 1.0 - 0.5 * (1 - cos(length * pi() / 1000)) / 2 ELSE -0.5 + 0.5 * (1 - cos(length * pi() / 1000)) / 2 END, 6) AS reward FROM fx_lengths")
def cosine_length_reward(x: Inputs) -> DataFrame:
    return rounded(x.fx_lengths.select("idx", tk.cosine_length(F.col("length"), F.col("idx") % 2 == 0).alias("reward")), "reward")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS reward FROM events")
def action_match(x: Inputs) -> DataFrame:
    k = F.col("event_id")
    ref = F.format_string('Action: find\nAction Input: {"a": "%d", "b": 2}', k)
    pred = F.when(k % 4 == 0, F.format_string('Thought: x\nAction: find\nAction Input: {"b": 2, "a": "%d"}\nObservation: y', k)).when(k % 4 == 1, F.format_string('Action: seek\nAction Input: {"a": "%d", "b": 2}', k)).when(k % 4 == 2, F.format_string('Action: find\nAction Input: {"a": "%d", "b": 3}', k)).otherwise("Action: find\nAction Input: a")
    return x.events.select("event_id", tk.action_match(pred, ref).alias("reward"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id || '/2' WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS answer FROM events")
def boxed_answer(x: Inputs) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.format_string(r"so # Answer \boxed{ %d/2 }.", k)).when(k % 3 == 1, F.format_string(r"\(%d\)", k)).otherwise("{x}")
    return x.events.select("event_id", tk.boxed_answer(text).alias("answer"))


# --- requests and answers -----------------------------------------------------------------------
def _tenth(c: str) -> str:
    return f"({c} // 10) || '.' || ({c} % 10)"


@query(
    f"""WITH p AS (SELECT *, lag(emotion) OVER w AS pe, lag(end_ds) OVER w AS pd FROM fx_segments WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx))
    SELECT video_id || '-' || seg_idx AS request_id, 'Describe what happens from ' || {_tenth('start_ds')} || ' s to ' || {_tenth('end_ds')} || ' s. Before: ' || COALESCE(pe || ' until ' || {_tenth('pd')} || ' s', 'nothing') AS prompt FROM p"""
)
def build_requests(x: Inputs) -> DataFrame:
    return an.build_requests(x.fx_segments, "describe").select("request_id", "prompt")


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' WHEN event_id % 4 = 0 THEN emotion ELSE 'Joy' END AS emotion, CAST(CASE WHEN event_id % 4 = 3 THEN 0 WHEN event_id % 4 = 1 THEN 3 ELSE 1 END AS INT) AS selected_pair_index, event_id % 4 = 3 AS parse_error FROM fx_segments"""
)
def parse_reason_output(x: Inputs) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 3, "no json").otherwise(F.concat(F.lit('{"candidate_pairs": [{"emotion": "Fear", "reason": "a"}, {"emotion": "Joy", "reason": "b"}], "selected_pair_index": '), F.when(k == 1, "9").otherwise("1"), F.when(k == 0, F.format_string(', "emotion": "%s"}', "emotion")).otherwise("}")))
    rows = x.fx_segments.select("event_id", text.alias("output"))
    return an.parse_reason_output(rows).select("event_id", "emotion", "selected_pair_index", "parse_error")


def _sft(x: Inputs) -> DataFrame:
    text = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("seg_idx", (F.col("start_ds") / 10).alias("start_time"), (F.col("end_ds") / 10).alias("end_time"), "emotion"))).alias("segments")))
    g = x.fx_segments.groupBy("video_id").agg(text.alias("t")).join(x.fx_videos, "video_id")
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    return g.select(F.col("video_id").alias("idx"), F.col("file").alias("video"), F.lit(None).cast("double").alias("duration"), "dur_ds", F.array(turn("human", F.lit("<video>")), turn("gpt", F.col("t"))).alias("conversations"))


@query(f"SELECT lpad(CAST(v.video_id AS VARCHAR), 6, '0') AS id, md5('<video>' || chr(10) || 'The video lasts ' || {_tenth('dur_ds')} || 's. Annotate it.') AS user_md5, CASE WHEN file IS NULL THEN 'missing video' END AS error FROM fx_videos v WHERE EXISTS (SELECT 1 FROM fx_segments s WHERE s.video_id = v.video_id)")
def to_rl_rows(x: Inputs) -> DataFrame:
    out = an.to_rl_rows(_sft(x), "You annotate videos.")
    return out.select("id", _md5(F.col("messages")[1]["content"]).alias("user_md5"), "error")


@query("SELECT v.video_id, COUNT(*) AS n_segments, CAST(v.video_id AS VARCHAR) AS stem FROM fx_videos v JOIN fx_segments s ON v.video_id = s.video_id WHERE file IS NOT NULL GROUP BY v.video_id")
def parse_conversation_answer(x: Inputs) -> DataFrame:
    s = _sft(x).where("video IS NOT NULL")
    n = F.size(F.from_json(an.parse_conversation_answer(s), "struct<segments:array<struct<emotion:string>>>")["segments"])
    return s.select(F.col("idx").alias("video_id"), n.cast("long").alias("n_segments"), an.video_stem(F.col("video")).alias("stem"))


@query("SELECT c_custkey, md5('{\"c_custkey\":' || c_custkey || ',\"c_nationkey\":' || c_nationkey || '}') AS id FROM customer")
def row_md5(x: Inputs) -> DataFrame:
    rows = x.customer.select("c_nationkey", "c_custkey")
    return rows.select("c_custkey", an.row_md5(rows).alias("id"))


@query("SELECT video_id || '-' || seg_idx AS request_id, CASE WHEN event_id % 5 <> 0 THEN 'ok ' || event_id END AS output, CASE WHEN event_id % 5 = 0 THEN 'no output' END AS error, CAST(CASE WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 5 = 1 THEN 2 ELSE 1 END AS INT) AS attempts FROM fx_segments")
def annotate_with(x: Inputs) -> DataFrame:
    def model(frame: pd.DataFrame) -> list:
        late = frame["attempt"] > 0
        return [None if e % 5 == 0 or e % 5 == 1 and not again else f"ok {e}" for e, again in zip(frame["event_id"], late, strict=True)]

    rows = x.fx_segments.select(F.concat_ws("-", "video_id", "seg_idx").alias("request_id"), "event_id")
    return an.annotate_with(rows, model, scratch(x, "annotated"), key="request_id", batches=3).select("request_id", "output", "error", "attempts")


@query("SELECT video_id || '-' || seg_idx AS request_id, CASE WHEN event_id % 4 = 3 THEN 'draft' ELSE 'final ' || event_id END AS output, CAST(CASE WHEN event_id % 4 = 3 THEN 3 ELSE event_id % 4 + 1 END AS INT) AS round FROM fx_segments")
def annotate_rounds(x: Inputs) -> DataFrame:
    """A model that is done with a row in the round that the row's event names, if it is one of three."""
    def model(frame: pd.DataFrame) -> list:
        kind = frame["event_id"] % 4
        return [f"final {e}" if k < 3 and r == k + 1 else "draft" for e, k, r in zip(frame["event_id"], kind, frame["round"], strict=True)]

    rows = x.fx_segments.select(F.concat_ws("-", "video_id", "seg_idx").alias("request_id"), "event_id")
    done = lambda output: output.startswith("final")
    return an.annotate_rounds(rows, model, done, scratch(x, "rounds"), rounds=3).select("request_id", "output", "round")


# --- files and streams --------------------------------------------------------------------------
@query("SELECT video_id, dur_ds FROM fx_videos WHERE video_id % 3 <> 0")
def read_jsonl(x: Inputs) -> DataFrame:
    path = scratch(x, "jsonl")
    line = F.when(F.col("video_id") % 3 == 0, F.concat(F.lit("{bad "), F.col("video_id").cast("string"))).otherwise(F.to_json(F.struct("video_id", F.col("dur_ds").cast("long").alias("dur_ds"))))
    x.fx_videos.select(line.alias("value")).write.text(path)
    return io.read_jsonl(x.spark, path, "video_id long, dur_ds long")


def _part(df: DataFrame, id_: str, rows: int = 5000) -> Column:
    """Which of the files of about ``rows`` rows an id falls into."""
    return F.pmod(F.xxhash64(id_), F.lit(max(1, -(-df.count() // rows))))


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(dur_ds / 10.0 AS DOUBLE) AS duration FROM fx_videos")
def read_keyed_json(x: Inputs) -> DataFrame:
    path = scratch(x, "keyed")
    one = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("video_id").cast("string"), F.struct((F.col("dur_ds") / 10).alias("duration"))))))
    groups = x.fx_videos.groupBy(_part(x.fx_videos, "video_id").alias("part")).agg(one.alias("value"))
    groups.write.partitionBy("part").text(path)  # one object a file
    return io.read_keyed_json(x.spark, path, "duration double").select("video_id", "duration")


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations")
def read_id_list(x: Inputs) -> DataFrame:
    path = scratch(x, "ids")
    ids = x.conversations.select(F.col("conv_id").cast("string").alias("id")).distinct()
    ids.groupBy(_part(ids, "id").alias("part")).agg(F.to_json(F.collect_list("id")).alias("value")).write.partitionBy("part").text(path)
    return io.read_id_list(x.spark, path).select("id")


@query("SELECT idx, length FROM fx_lengths")
def write_jsonl(x: Inputs) -> DataFrame:
    path = scratch(x, "out")
    io.write_jsonl(x.fx_lengths.where("idx % 2 = 0"), path)
    io.write_jsonl(x.fx_lengths.where("idx % 2 = 1"), path, "append")
    return io.read_jsonl(x.spark, path, "idx long, length long")


@query("SELECT idx, length FROM fx_lengths")
def strict_mode(x: Inputs) -> DataFrame:
    path = scratch(x, "strict")
    io.write_jsonl(x.fx_lengths, path)
    return io.read_jsonl(x.spark, path, "idx long, length long", strict=True)


@query(f"WITH {PAIRS} SELECT video_id, pred_count, gt_count, compared FROM pv")
def write_metrics_report(x: Inputs) -> DataFrame:
    path, p = scratch(x, "report"), pairs(x)
    io.write_metrics_report(ev.eval_overall(p), ev.eval_per_video(p).drop("_iou"), path)
    return x.spark.read.schema("video_id long, pred_count long, gt_count long, compared long").json(f"{path}/per_video")


@query(f"WITH {SIDES[:-1]} SELECT request_id, round(least(length(completion), 500) / 500.0, 6) AS brevity, CAST(NULL AS DOUBLE) AS missing, round(least(length(completion), 500) / 500.0, 6) AS total FROM ct")
def reward_registry(x: Inputs) -> DataFrame:
    """Rewards that a user adds: a batch function over completions, and one that is missing."""

    @F.pandas_udf("double")
    def brevity(texts: pd.Series) -> pd.Series:
        return texts.str.len().clip(upper=500) / 500.0

    own = {
        "brevity": lambda requests, pred, truth: requests.select("request_id", brevity("completion").alias("reward")),
        "missing": lambda requests, pred, truth: requests.select("request_id", F.lit(None).cast("double").alias("reward")),
    }
    requests, _, truth = sides(x)
    out = rw.score(requests, truth, ("brevity", "missing"), rw.REGISTRY | own)
    return rounded(out.withColumn("total", rw.weighted_reward(out, {"brevity": 1.0, "missing": 1.0})), "brevity", "total")


@query("SELECT event_id, least(greatest(start_ds, 50), 40 + end_ds % 100) AS clamped FROM fx_raw_segments")
def clamp_times(x: Inputs) -> DataFrame:
    return x.fx_raw_segments.select("event_id", clamp(F.col("start_ds"), F.lit(50), 40 + F.col("end_ds") % 100).alias("clamped"))


@query("SELECT prompt_id AS query_id, request_id AS positive FROM fx_rollouts")
def all_choices(x: Inputs) -> DataFrame:
    rows = x.fx_rollouts.select(F.col("prompt_id").alias("query_id"), F.col("pos").alias("idx"), F.col("request_id").alias("choice"))
    return adv.all_choices(rows).select("query_id", "positive")


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer")
def read_dataset(x: Inputs) -> DataFrame:
    path = scratch(x, "table") + ".csv"
    x.customer.select("c_custkey", "c_nationkey").write.option("header", True).csv(path)
    return io.read_dataset(x.spark, path, schema="c_custkey bigint, c_nationkey bigint", columns={"c_custkey": "id", "c_nationkey": "nation"}).select("id", F.col("nation").cast(x.customer.schema["c_nationkey"].dataType))


@query("SELECT idx, length FROM fx_lengths WHERE length <= 700")
def length_cache(x: Inputs) -> DataFrame:
    path = scratch(x, "cache")
    io.write_length_cache(x.fx_lengths, path)
    return io.read_length_cache(x.spark, path, 700)


@query("SELECT idx, length, NULL AS n FROM fx_lengths UNION ALL SELECT conv_id, NULL, COUNT(*) FROM conversations GROUP BY conv_id")
def ragged_union(x: Inputs) -> DataFrame:
    return io.ragged_union(x.fx_lengths, x.conversations.groupBy(F.col("conv_id").alias("idx")).agg(F.count("*").alias("n")))


@query("SELECT video_id, CAST(dur_ds AS INT) AS dur_ds, n_points FROM fx_videos WHERE n_points > 1")
def incremental_stage(x: Inputs) -> DataFrame:
    """Two runs: the first on half of the files, the second on those that came after."""
    base = scratch(x, "stage")
    rows = x.fx_videos.select("video_id", F.col("dur_ds").cast("int").alias("dur_ds"), "n_points")
    for half in (0, 1):
        rows.where(F.col("video_id") % 2 == half).write.mode("append").parquet(f"{base}/in")
        jobs.incremental_stage(x.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", rows.schema, lambda df: df.where("n_points > 1")).awaitTermination()
    return x.spark.read.parquet(f"{base}/out")


@query("SELECT time_bucket(INTERVAL '20 seconds', ts) AS start, COUNT(*) AS n_requests, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(generated_tokens) AS BIGINT) AS generated_tokens, round(COUNT(*) / 20.0, 6) AS requests_per_s, round(SUM(generated_tokens) / 20.0, 6) AS tokens_per_s FROM fx_requests GROUP BY ALL")
def interval_throughput(x: Inputs) -> DataFrame:
    """As a stream over files, in complete mode, run until all is read."""
    base = scratch(x, "requests")
    rows = x.fx_requests.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{base}/in")
    stream = x.spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    out = jobs.interval_throughput(stream, late="36500 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = x.spark.read.parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
    return rounded(got, "requests_per_s", "tokens_per_s")


@query(
    """WITH r AS (SELECT ts, request_id % 10 = 0 AS late, epoch_us(time_bucket(INTERVAL '20 seconds', ts)) + 20000000 AS w_end FROM fx_requests),
    w AS (SELECT MAX(epoch_us(ts)) FILTER (WHERE NOT late) - 864000000000 AS w1, MAX(epoch_us(ts)) - 864000000000 AS w2 FROM r)
    SELECT time_bucket(INTERVAL '20 seconds', ts) AS start, COUNT(*) AS n_requests FROM r, w WHERE NOT (late AND w_end <= w1) AND w_end <= w2 GROUP BY ALL"""
)
def late_requests(x: Inputs) -> DataFrame:
    """As a stream in append mode: a tenth of the requests comes after the others. Of these, those in
    intervals that the watermark of ten days has closed are dropped, and open intervals aren't given."""
    base, rows = scratch(x, "late"), x.fx_requests.withColumn("ts", F.col("ts").cast("timestamp"))
    for late in (False, True):
        rows.where((F.col("request_id") % 10 == 0) == F.lit(late)).write.mode("append").parquet(f"{base}/in")
        out = jobs.interval_throughput(x.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), late="10 days")
        stream = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
        stream.trigger(availableNow=True).start().awaitTermination()
    return x.spark.read.parquet(f"{base}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "n_requests")


def _restarts(last: int) -> str:
    """A pair of tables a run: what the run takes, and each id's time of last being taken. The watermark of
    a run is two days behind the latest time of the runs before."""
    ctes = ["r AS (SELECT user_id, run, MIN(ts) AS ts, COUNT(*) AS n FROM (SELECT user_id, ts, ((day(ts) - 1) // 3) % 4 AS run FROM events) GROUP BY ALL)",
            "s0 AS (SELECT NULL::BIGINT AS user_id, NULL::TIMESTAMP AS ts WHERE false)"]
    for k in range(last):
        mark = f"COALESCE((SELECT MAX(ts) - INTERVAL '2 days' FROM r WHERE run < {k}), TIMESTAMP '1970-01-01')"
        ctes.append(f"e{k} AS (SELECT r.* FROM r LEFT JOIN s{k} s USING (user_id) WHERE run = {k} AND r.ts > {mark} AND (s.ts IS NULL OR s.ts + INTERVAL '2 days' <= {mark}))")
        ctes.append(f"s{k + 1} AS (SELECT user_id, arg_max(ts, k) AS ts FROM (SELECT user_id, ts, 0 AS k FROM s{k} UNION ALL SELECT user_id, ts, 1 FROM e{k}) GROUP BY user_id)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT user_id, CAST(run AS INT) AS run, n FROM e{k}" for k in range(last))


@query(_restarts(4))
def incremental_stage_by_id(x: Inputs) -> DataFrame:
    """Four runs of a stage that takes each user once, restarted from its state. The runs get every fourth
    span of three days, so that users come again before and after their state has gone, and late."""
    base = scratch(x, "by-id")
    days = x.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.floor((F.dayofmonth("ts") - 1) / 3) % 4).cast("int").alias("run"))
    rows = days.groupBy("user_id", "run").agg(F.min("ts").alias("ts"), F.count("*").alias("n")).select("user_id", "run", "ts", "n")
    for run in range(4):
        rows.where(F.col("run") == run).write.mode("append").parquet(f"{base}/in")
        jobs.incremental_stage(x.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", rows.schema, key="user_id", time="ts", late="2 days").awaitTermination()
    return x.spark.read.schema(rows.schema).parquet(f"{base}/out").select("user_id", "run", "n")


@query(
    """WITH r AS (SELECT request_id % 500 AS id, ts, request_id % 10 = 0 AS late, prompt_tokens AS p, generated_tokens AS g, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start FROM fx_requests),
    w AS (SELECT epoch_us(MAX(ts) FILTER (WHERE NOT late)) - 864000000000 AS w1, epoch_us(MAX(ts)) - 864000000000 AS w2 FROM r),
    l AS (SELECT start, id, p, g FROM r, w WHERE NOT (late AND epoch_us(start) + 21600000000 <= w1) AND epoch_us(start) + 21600000000 <= w2 QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY ts DESC, g DESC, p DESC) = 1)
    SELECT start, COUNT(*) AS n_requests, CAST(SUM(p) AS BIGINT) AS prompt_tokens, CAST(SUM(g) AS BIGINT) AS generated_tokens, round(COUNT(*) / 21600.0, 6) AS requests_per_s, round(SUM(g) / 21600.0, 6) AS tokens_per_s FROM l GROUP BY start"""
)
def interval_usage(x: Inputs) -> DataFrame:
    """As a stream in append mode over a restart: requests report up to some hundred times, a tenth of the
    reports comes after the others, and of these those in closed intervals are dropped."""
    base = scratch(x, "usage")
    rows = x.fx_requests.select((F.col("request_id") % 500).alias("id"), (F.col("request_id") % 10 == 0).alias("late"), F.col("ts").cast("timestamp").alias("ts"), "prompt_tokens", "generated_tokens")
    for late in (False, True):
        rows.where(F.col("late") == F.lit(late)).write.mode("append").parquet(f"{base}/in")
        out = jobs.interval_usage(x.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), id_="id", interval="6 hours", late="10 days")
        stream = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
        stream.trigger(availableNow=True).start().awaitTermination()
    got = x.spark.read.parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
    return rounded(got, "requests_per_s", "tokens_per_s")


@query("SELECT conv_id, MAX(turn) AS turn, COUNT(*) AS n FROM conversations GROUP BY conv_id")
def last_message(x: Inputs) -> DataFrame:
    n = x.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return last_wins(x.conversations.select("conv_id", "turn"), ["conv_id"], "turn").join(n, "conv_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_idx FROM orders")
def with_row_index(x: Inputs) -> DataFrame:
    return sp.with_row_index(x.orders, [-F.col("o_totalprice"), "o_orderkey"]).select("o_orderkey", "row_idx")
