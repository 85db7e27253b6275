"""Inputs that portable SQL derives from the given tables: timelines, judgements, rollouts, messages.

One video is one day of one user. The same text makes the Spark views and the CTEs of the oracle
SQL, so that either engine starts from equal rows. Times are integer deciseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "fx_points": """
        SELECT CAST(user_id*100 + day(ts) AS BIGINT) AS video_id, event_id, event_type, value,
               hour(ts)*60 + minute(ts) AS t_ds FROM events
    """,
    "fx_videos": """
        SELECT video_id, MAX(t_ds) + 1 + CAST(MAX(event_id) % 50 AS INT) AS dur_ds, CAST(COUNT(*) AS BIGINT) AS n_points,
               CASE WHEN video_id % 17 = 0 THEN NULL ELSE concat('videos/', CAST(video_id AS STRING), '.mp4') END AS file
        FROM fx_points GROUP BY video_id
    """,
    "fx_files": """
        SELECT file FROM fx_videos WHERE file IS NOT NULL AND video_id % 10 <> 0
    """,
    "fx_raw_segments": """
        SELECT video_id, event_id, event_type, COALESCE(LAG(t_ds) OVER (PARTITION BY video_id ORDER BY t_ds, event_id), 0) AS start_ds, t_ds AS end_ds,
               CASE event_type WHEN 'click' THEN 'Joy' WHEN 'view' THEN 'Interest' WHEN 'purchase' THEN 'Excitement' WHEN 'signup' THEN 'Surprise' ELSE 'Fear' END AS emotion
        FROM fx_points
    """,
    "fx_cuts": """
        SELECT DISTINCT video_id, t_ds + CAST(event_id % 13 AS INT) - 6 AS cut_ds FROM fx_points WHERE event_id % 3 <> 0
    """,
    "fx_reasons": """
        SELECT p.event_id, d.text AS reason
        FROM fx_points p CROSS JOIN (SELECT COUNT(*) AS n_docs FROM documents) c JOIN documents d ON d.doc_id = p.event_id % c.n_docs
    """,
    "fx_pred_raw": """
        SELECT video_id, event_id, start_ds + CAST(event_id % 5 AS INT) - 2 AS start_ds, end_ds + CAST(event_id % 11 AS INT) - 5 AS end_ds,
               CASE WHEN event_id % 8 = 0 THEN lower(emotion) WHEN event_id % 8 = 1 THEN concat(emotion, 'ful') WHEN event_id % 8 = 2 THEN '' WHEN event_id % 8 = 3 THEN 'Unlisted' ELSE emotion END AS emotion
        FROM fx_raw_segments WHERE event_id % 7 <> 0
    """,
    "fx_judgements": """
        SELECT j.judge, s.video_id, CAST(row_number() OVER (PARTITION BY j.judge, s.video_id ORDER BY s.event_id) - 1 AS INT) AS segment_index, s.event_id AS pos,
               CAST((s.event_id * 7 + j.k) % 6 AS INT) AS visual_grounding, CAST((s.event_id * 5 + j.k) % 6 AS INT) AS causal_logic, CAST((s.event_id * 3 + j.k) % 6 AS INT) AS viewer_centricity,
               CAST((s.event_id + j.k) % 6 AS INT) AS temporal_consistency, CAST((s.event_id * 11 + j.k) % 6 AS INT) AS answer_consistency,
               CASE WHEN s.event_id % 4 = 0 THEN NULL WHEN s.event_id % 4 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(s.event_id % 50 AS DOUBLE) / 10 END AS average_score
        FROM fx_raw_segments s JOIN (SELECT 'a' AS judge, 1 AS k UNION ALL SELECT 'b' AS judge, 4 AS k) j ON (s.event_id + j.k) % 6 <> 0
    """,
    "fx_rollouts": """
        SELECT l_orderkey AS prompt_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS request_id, l_partkey AS pos,
               CAST((l_orderkey * 31 + l_linenumber * 17) % 11 AS DOUBLE) / 10 AS r_struct,
               CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE CAST((l_orderkey * 13 + l_linenumber * 7) % 11 AS DOUBLE) / 10 END AS r_count,
               CAST((l_orderkey * 3) % 5 AS DOUBLE) / 4 AS r_emotion
        FROM lineitem
    """,
    "fx_messages": """
        SELECT conv_id, turn, role, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN concat('<video>', text) WHEN role = 'assistant' AND conv_id % 23 = 0 THEN concat(text, '<image>') ELSE text END AS content FROM conversations
    """,
    "fx_frames": """
        SELECT CAST(label AS BIGINT) AS video_id, vec_id AS frame_idx, CAST((vec_id * 2654435761) % 4294967296 AS BIGINT) AS ahash, CAST(vec_id % 10 AS DOUBLE) / 10 AS flow FROM embeddings
    """,
    "fx_ranking": """
        SELECT vec_id AS pos, CASE WHEN vec_id % 5 = 0 OR vec_id % 7 = 0 THEN 1 ELSE 0 END AS label, CAST((vec_id * 7919) % 1009 AS DOUBLE) / 1009 AS logit FROM embeddings
    """,
    "fx_lengths": """
        SELECT doc_id AS idx, CAST((n_chars - n_chars % 4) / 4 AS BIGINT) AS length FROM documents
    """,
    "fx_requests": """
        SELECT event_id AS request_id, ts, CAST(event_id % 97 AS INT) AS prompt_tokens, CAST(event_id % 53 AS INT) AS generated_tokens FROM events
    """,
    "fx_segments": """
        WITH k AS (
          SELECT r.video_id, r.event_id, r.emotion, v.dur_ds, least(greatest(r.start_ds, 0), v.dur_ds) AS cs, least(greatest(r.end_ds, 0), v.dur_ds) AS ce
          FROM fx_raw_segments r JOIN fx_videos v ON r.video_id = v.video_id WHERE r.end_ds > r.start_ds),
        o AS (SELECT k.*, row_number() OVER (PARTITION BY video_id ORDER BY cs, ce, event_id) - 1 AS i, COUNT(*) OVER (PARTITION BY video_id) AS n FROM k),
        f AS (SELECT o.*, MAX(ce - i) OVER (PARTITION BY video_id ORDER BY i) AS m FROM o),
        g AS (SELECT f.*, CASE WHEN i = n - 1 THEN dur_ds ELSE least(dur_ds - (n - 1), greatest(1, m)) + i END AS e FROM f)
        SELECT video_id, CAST(i AS INT) AS seg_idx, CAST(COALESCE(LAG(e) OVER (PARTITION BY video_id ORDER BY i), 0) AS INT) AS start_ds, CAST(e AS INT) AS end_ds, emotion, event_id FROM g
    """,
}


_FROM = re.compile(r"(?i)\b(FROM|JOIN)\s+(" + "|".join(sorted([*VIEWS, *TABLES], key=len, reverse=True)) + r")\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir`` or a derived view of it."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {m[2]: view(spark, sf_dir, m[2]) for m in _FROM.finditer(sql)}
    return spark.sql(_FROM.sub(lambda m: f"{m[1]} {{{m[2]}}}", sql), **used)


def with_views(body: str) -> str:
    """The query with the views that it needs, and those that they need, as CTEs in front."""
    order: list[str] = []

    def need(sql: str) -> None:
        for m in _FROM.finditer(sql):
            if m[2] in VIEWS and m[2] not in order:
                need(VIEWS[m[2]])
                order.append(m[2])

    need(body)
    own = body.strip()
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in dict.fromkeys(order)]
    for head in ("WITH RECURSIVE ", "WITH "):
        if own.startswith(head):
            return head + ", ".join([*ctes, own[len(head) :]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + own
