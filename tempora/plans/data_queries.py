"""Queries on manifests, checks, samples, batches, packing and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.intervals import interval_iou, interval_overlap, round_time
from ..functions.labels import jaccard, token_set, word_count
from ..operators import manifest as mf
from ..operators import metrics as mt
from ..operators import pack as pk
from ..operators import sampling as sp
from .registry import Inputs, query, rounded

# --- manifests and checks -----------------------------------------------------------------------
_STATIC = """fr AS (SELECT video_id, flow, frame_idx, bit_count(xor(ahash, lag(ahash) OVER (PARTITION BY video_id ORDER BY frame_idx))) AS d FROM fx_frames),
    st AS (SELECT video_id, COALESCE(avg(d), 0) AS hamming, COALESCE(avg(CASE WHEN d IS NOT NULL THEN flow END), 0) AS flow FROM fr GROUP BY video_id)"""


def videos(x: Inputs) -> DataFrame:
    return x.fx_videos.select("video_id", "file", F.when(F.col("n_points") % 5 != 0, F.col("dur_ds") / 10).alias("duration"))


def _manifest(x: Inputs) -> DataFrame:
    return mf.build_manifest(videos(x), x.fx_files, mf.static_video_filter(x.fx_frames))


_MANIFEST = f"""{_STATIC}, mm AS (SELECT v.video_id, CASE WHEN f.file IS NULL THEN 'missing_video' WHEN n_points % 5 = 0 THEN 'missing_duration' WHEN dur_ds / 10.0 < 1 THEN 'duration_lt_minimum'
    WHEN hamming <= 4 AND flow <= 0.25 THEN 'static_or_slideshow' ELSE '' END AS drop_reason FROM fx_videos v LEFT JOIN fx_files f ON v.file = f.file LEFT JOIN st ON st.video_id = v.video_id)"""


@query(f"WITH {_MANIFEST} SELECT video_id, drop_reason, drop_reason = '' AS keep FROM mm")
def build_manifest(x: Inputs) -> DataFrame:
    return _manifest(x).select("video_id", "drop_reason", "keep")


@query(f"WITH {_MANIFEST} SELECT drop_reason, COUNT(*) AS n, CAST(SUM(CASE WHEN drop_reason = '' THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM mm GROUP BY drop_reason")
def manifest_counts(x: Inputs) -> DataFrame:
    return mf.manifest_counts(_manifest(x))


@query(f"WITH {_MANIFEST} SELECT video_id FROM mm WHERE drop_reason = ''")
def keep_filter(x: Inputs) -> DataFrame:
    return mf.keep_filter(_manifest(x)).select("video_id")


@query(f"WITH {_STATIC} SELECT video_id, round(hamming, 6) AS hamming, round(flow, 6) AS flow, hamming <= 4 AND flow <= 0.25 AS static FROM st")
def static_video_filter(x: Inputs) -> DataFrame:
    return rounded(mf.static_video_filter(x.fx_frames), "hamming", "flow")


@query("SELECT v.video_id, COALESCE(f.file, g.file, v.file) AS resolved, COALESCE(f.file, g.file) IS NOT NULL AS exists FROM fx_videos v LEFT JOIN fx_files f ON v.file = f.file LEFT JOIN fx_files g ON g.file = 'videos/' || v.video_id || '.mp4'")
def resolve_media_path(x: Inputs) -> DataFrame:
    return mf.resolve_media_path(x.fx_videos.select("video_id", "file"), x.fx_files, "videos").select("video_id", "resolved", "exists")


@query("SELECT video_id, '/data/' || CASE WHEN starts_with(file, 'videos/') THEN 'clips/' || substr(file, 8) ELSE file END AS resolved FROM fx_videos")
def swap_media_prefix(x: Inputs) -> DataFrame:
    return mf.resolve_media_path(x.fx_videos.select("video_id", "file"), x.fx_files, "/data", ("videos/", "clips/")).select("video_id", "resolved")


@query("SELECT video_id, COUNT(*) AS n_segments, CASE WHEN NOT COUNT(*) BETWEEN 1 AND 3 THEN 'segments: ' || COUNT(*) END AS error FROM fx_segments GROUP BY video_id")
def segment_count_guard(x: Inputs) -> DataFrame:
    return mf.segment_count_guard(x.fx_segments.groupBy("video_id").agg(F.count("*").alias("n_segments")), 1, 3)


@query("SELECT video_id, CASE WHEN file IS NULL AND n_points % 5 = 0 THEN 'missing: file,duration' WHEN file IS NULL THEN 'missing: file' ELSE 'missing: duration' END AS error FROM fx_videos WHERE file IS NULL OR n_points % 5 = 0")
def route_errors(x: Inputs) -> DataFrame:
    return mf.route_errors(videos(x), ("file", "duration"))[1].select("video_id", "error")


@query(
    """WITH s AS (SELECT p.video_id, row_number() OVER w AS i, start_ds / 10.0 AS s, end_ds / 10.0 AS e, emotion, lag(end_ds / 10.0) OVER w AS pe, lag(emotion) OVER w AS pm, lead(event_id) OVER w IS NULL AS fin
      FROM fx_pred_raw p WINDOW w AS (PARTITION BY p.video_id ORDER BY start_ds, event_id)),
    r AS (SELECT s.video_id, i, CASE WHEN e <= s THEN 'end_not_after_start' WHEN emotion NOT IN ('Joy', 'Interest', 'Excitement', 'Surprise', 'Fear') THEN 'unknown_emotion' WHEN i = 1 AND abs(s) > 0.15 THEN 'first_start_not_zero'
      WHEN i > 1 AND abs(s - pe) > 0.15 THEN 'not_contiguous' WHEN i > 1 AND emotion = pm THEN 'same_emotion' WHEN fin AND abs(e - dur_ds / 10.0) > 0.15 THEN 'end_not_duration' END AS err FROM s JOIN fx_videos v ON s.video_id = v.video_id),
    f AS (SELECT video_id, arg_min(err, i) FILTER (WHERE err IS NOT NULL) AS err FROM r GROUP BY video_id)
    SELECT v.video_id, CASE WHEN file IS NULL THEN 'missing_video' WHEN dur_ds <= 0 THEN 'bad_duration' WHEN f.video_id IS NULL THEN 'empty_segments' ELSE err END AS error FROM fx_videos v LEFT JOIN f ON v.video_id = f.video_id"""
)
def validate_segments(x: Inputs) -> DataFrame:
    rows = x.fx_videos.select("video_id", "file", (F.col("dur_ds") / 10).alias("duration"), F.array(F.lit("human"), F.lit("gpt")).alias("roles"), F.lit(True).alias("is_json"))
    s = x.fx_pred_raw.select("video_id", F.struct("start_ds", "event_id").alias("seg_idx"), (F.col("start_ds") / 10).alias("start"), (F.col("end_ds") / 10).alias("end"), "emotion", F.lit("why").alias("reason"))
    return mf.validate_segments(rows, s)


def _checked(x: Inputs) -> DataFrame:
    media = x.fx_messages.select("conv_id").distinct().where("conv_id % 3 = 0").select("conv_id", F.lit("video").alias("kind"), F.concat(F.lit("videos/"), F.col("conv_id").cast("string"), F.lit(".mp4")).alias("path"))
    return mf.check_media_tokens(x.fx_messages, media, media.where("conv_id % 5 <> 0").select(F.col("path").alias("file")))


_MEDIA = """tk AS (SELECT conv_id, CAST(SUM(CASE WHEN role = 'user' THEN len(regexp_extract_all(content, '<image>')) ELSE 0 END) AS BIGINT) AS it, CAST(SUM(CASE WHEN role = 'user' THEN len(regexp_extract_all(content, '<video>')) ELSE 0 END) AS BIGINT) AS vt,
      SUM(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(content, '<(image|video)>')) ELSE 0 END) AS an FROM fx_messages GROUP BY conv_id),
    me AS (SELECT conv_id, it, vt, an, CAST(conv_id % 3 = 0 AS BIGINT) AS nv, conv_id % 3 = 0 AND conv_id % 5 = 0 AS gone FROM tk),
    ch AS (SELECT conv_id, it AS n_image_tokens, vt AS n_video_tokens, CAST(0 AS BIGINT) AS n_images, nv AS n_videos,
      concat_ws(';', CASE WHEN it <> 0 THEN 'image_mismatch' WHEN vt <> nv THEN 'video_mismatch' END, CASE WHEN an > 0 THEN 'tokens_in_answer' END, CASE WHEN gone THEN 'missing_media' END) AS problems FROM me)"""


@query(f"WITH {_MEDIA} SELECT * FROM ch")
def check_media_tokens(x: Inputs) -> DataFrame:
    return _checked(x)


@query(
    f"""WITH {_MEDIA} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE problems = '') AS valid, COUNT(*) FILTER (WHERE contains(problems, 'missing_media')) AS missing_media, COUNT(*) FILTER (WHERE contains(problems, 'mismatch')) AS token_mismatch,
    COUNT(*) FILTER (WHERE contains(problems, 'tokens_in_answer')) AS answer_tokens, CAST(0 AS BIGINT) AS image_rows, COUNT(*) FILTER (WHERE n_videos > 0) AS video_rows, CAST(0 AS BIGINT) AS mixed_rows FROM ch"""
)
def media_check_stats(x: Inputs) -> DataFrame:
    return mf.media_check_stats(_checked(x))


_STOP = ", ".join(f"'{w}'" for w in mf.STOPWORDS)
_TERMS = f"""wd AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}')), '^-+|-+$', '', 'g') AS w FROM documents),
    wc AS (SELECT doc_id, w, COUNT(*) AS n FROM wd WHERE length(w) >= 3 AND w NOT IN ({_STOP}) GROUP BY ALL),
    tp AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM wc QUALIFY r <= 8)"""


def _terms(x: Inputs) -> DataFrame:
    return mf.top_terms(x.documents.select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {_TERMS} SELECT doc_id AS id, string_agg(w, ' ' ORDER BY r) AS terms FROM tp GROUP BY doc_id")
def top_terms(x: Inputs) -> DataFrame:
    return _terms(x).select("id", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {_TERMS}, de AS (SELECT doc_id, upper(w) AS label, (doc_id * 7 + r * 13) % 100 / 200.0 AS score FROM tp), g AS (SELECT doc_id, COUNT(DISTINCT lower(label)) AS n FROM de WHERE score >= 0.25 GROUP BY ALL) SELECT t.doc_id AS id, COALESCE(n, 0) AS n_grounded, COALESCE(n, 0) >= 2 AS passed FROM (SELECT DISTINCT doc_id FROM tp) t LEFT JOIN g ON t.doc_id = g.doc_id")
def grounding_filter(x: Inputs) -> DataFrame:
    t = _terms(x)
    d = t.select("id", F.posexplode("terms").alias("r", "w")).select("id", F.upper("w").alias("label"), ((F.col("id") * 7 + (F.col("r") + 1) * 13) % 100 / 200).alias("score"))
    return mf.grounding_filter(t, d, min_terms=2).select("id", "n_grounded", "passed")


_TOP3 = "ec AS (SELECT video_id, emotion, COUNT(*) AS n FROM fx_raw_segments GROUP BY ALL), t3 AS (SELECT video_id, string_agg(emotion, ',' ORDER BY n DESC, emotion) AS t FROM (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, emotion) <= 3) GROUP BY video_id)"


def _top3(x: Inputs) -> DataFrame:
    counts = x.fx_raw_segments.groupBy("video_id", "emotion").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("emotion", "n")))).alias("emotions"))
    return maps.select("video_id", mf.top3_emotions(maps).alias("top3"))


@query(f"WITH {_TOP3} SELECT video_id, t AS top3 FROM t3")
def top3_emotions(x: Inputs) -> DataFrame:
    return _top3(x).select("video_id", F.array_join("top3", ",").alias("top3"))


@query(f"WITH {_TOP3} SELECT v.video_id, CASE WHEN v.video_id % 2 = 0 THEN t WHEN v.video_id % 3 = 0 THEN 'Fear' ELSE '' END AS top3 FROM fx_videos v LEFT JOIN t3 ON v.video_id = t3.video_id")
def attach_top3(x: Inputs) -> DataFrame:
    v = x.fx_videos.select("video_id")
    meta = v.where("video_id % 3 = 0").withColumn("top3", F.array(F.lit("Fear")))
    return mf.attach_top3(v, _top3(x).where("video_id % 2 = 0"), meta).select("video_id", F.array_join("top3", ",").alias("top3"))


@query(f"WITH {_TOP3} SELECT v.video_id, COALESCE(CASE WHEN v.video_id % 2 = 0 THEN t WHEN v.video_id % 3 = 0 THEN 'Fear' END, 'Admiration,Amusement,Anger') AS top3 FROM fx_videos v LEFT JOIN t3 ON v.video_id = t3.video_id")
def candidates_or_default(x: Inputs) -> DataFrame:
    v = x.fx_videos.select("video_id")
    meta = v.where("video_id % 3 = 0").withColumn("top3", F.array(F.lit("Fear")))
    found = mf.attach_top3(v, _top3(x).where("video_id % 2 = 0"), meta)
    return found.select("video_id", F.array_join(mf.candidates_or_default(F.col("top3")), ",").alias("top3"))


# --- order, samples, batches --------------------------------------------------------------------
@query("SELECT idx, length FROM fx_lengths ORDER BY idx LIMIT 91 OFFSET 10")
def index_range(x: Inputs) -> DataFrame:
    return sp.index_range(x.fx_lengths, ["idx"], 10, 100)


@query("WITH r AS (SELECT idx, length, row_number() OVER (ORDER BY idx) - 1 AS i, COUNT(*) OVER () // 7 AS e FROM fx_lengths) SELECT idx, length FROM r WHERE i >= 2 * e AND i < 3 * e")
def shard_range(x: Inputs) -> DataFrame:
    return sp.shard_range(x.fx_lengths, ["idx"], 2, 7)


@query("SELECT file, row_number() OVER (ORDER BY try_cast(s AS BIGINT) NULLS LAST, s) - 1 AS row_idx FROM (SELECT file, CASE WHEN video_id % 2 = 0 THEN CAST(video_id AS VARCHAR) ELSE file END AS s FROM fx_videos WHERE file IS NOT NULL)")
def natural_id_order(x: Inputs) -> DataFrame:
    rows = x.fx_videos.where("file IS NOT NULL").select("file", F.when(F.col("video_id") % 2 == 0, F.col("video_id").cast("string")).otherwise(F.col("file")).alias("s"))
    return sp.with_row_index(rows, sp.natural_id_order("s")).select("file", "row_idx")


@query("SELECT video_id FROM fx_videos ORDER BY video_id LIMIT 50")
def head_by_id(x: Inputs) -> DataFrame:
    return sp.head_by_id(x.fx_videos.select("video_id"), "video_id", 50)


@query("SELECT video_id, dur_ds, NULL AS n FROM fx_videos UNION ALL SELECT video_id, NULL, COUNT(*) FROM fx_cuts GROUP BY video_id")
def concat_datasets(x: Inputs) -> DataFrame:
    return sp.concat_datasets(x.fx_videos.select("video_id", F.col("dur_ds").cast("long").alias("dur_ds")), x.fx_cuts.groupBy("video_id").agg(F.count("*").alias("n"))).select("video_id", "dur_ds", "n")


@query("SELECT prompt_id, request_id, pos FROM fx_rollouts QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY pos, request_id) = 1")
def distinct_rows(x: Inputs) -> DataFrame:
    rows = x.fx_rollouts.select("prompt_id", "request_id", "pos").withColumn("o", F.struct("pos", "request_id"))
    return sp.distinct_rows(rows, ["prompt_id"], "o").drop("o")


@query("SELECT idx, CAST(0 AS INT) AS copy FROM fx_lengths ORDER BY md5(idx || '-42'), idx LIMIT 120")
def sample_count(x: Inputs) -> DataFrame:
    return sp.sample_count(x.fx_lengths.select("idx"), 120, id_="idx")


@query("WITH n AS (SELECT COUNT(*) AS c FROM fx_files), r AS (SELECT file, row_number() OVER (ORDER BY md5(file || '-42'), file) AS i FROM fx_files) SELECT file, CAST(k AS INT) AS copy FROM fx_files, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT file, 2 FROM r, n WHERE i <= c // 2")
def sample_with_copies(x: Inputs) -> DataFrame:
    n = x.fx_files.count()
    return sp.sample_count(x.fx_files, 2 * n + n // 2, id_="file")


@query("WITH n AS (SELECT COUNT(*) AS c FROM fx_lengths), r AS (SELECT idx, row_number() OVER (ORDER BY md5(idx || '-7'), idx) AS i FROM fx_lengths) SELECT idx, CAST(0 AS INT) AS copy FROM r, n WHERE i <= c * 30 // 100")
def sample_percent(x: Inputs) -> DataFrame:
    return sp.sample_percent(x.fx_lengths.select("idx"), 30, id_="idx", seed=7)


@query("SELECT conv_id, CAST(('0x' || substr(md5(conv_id || '-42'), 1, 8)) AS BIGINT) < 0.2 * 4294967296 AS held_out FROM (SELECT DISTINCT conv_id FROM conversations)")
def train_val_split(x: Inputs) -> DataFrame:
    train, val = sp.train_val_split(x.conversations.select("conv_id").distinct(), 0.2, id_="conv_id")
    return train.withColumn("held_out", F.lit(False)).unionByName(val.withColumn("held_out", F.lit(True)))


@query(
    """WITH RECURSIVE n AS (SELECT (SELECT COUNT(*) FROM customer) AS a, (SELECT COUNT(*) FROM supplier) AS b),
    d AS (SELECT i AS slot, CASE WHEN CAST(('0x' || substr(md5('42-' || i), 1, 8)) AS BIGINT) / 4294967296.0 < 0.7 THEN 0 ELSE 1 END AS source FROM n, unnest(range(0, a * 10)) t(i)),
    k AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM d), e AS (SELECT MIN(slot) AS fin FROM k, n WHERE k = CASE source WHEN 0 THEN a ELSE b END),
    r AS (SELECT 0 AS source, c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer UNION ALL SELECT 1, s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier)
    SELECT slot, CAST(k.source AS INT) AS source, id FROM k JOIN r ON k.source = r.source AND k.k = r.k, e WHERE slot < fin"""
)
def interleave(x: Inputs) -> DataFrame:
    a, b = x.customer.select(F.col("c_custkey").alias("id")), x.supplier.select(F.col("s_suppkey").alias("id"))
    return sp.interleave([a, b], [0.7, 0.3], ["id", "id"]).select("slot", "source", "id")


@query("WITH r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS i FROM fx_lengths) SELECT idx, COALESCE(lag(idx) OVER w, last_value(idx) OVER (PARTITION BY i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS negative FROM r WINDOW w AS (PARTITION BY i // 16 ORDER BY i)")
def circular_shift_negatives(x: Inputs) -> DataFrame:
    return sp.circular_shift_negatives(x.fx_lengths, 16, ["idx"], "idx").select("idx", "negative")


@query("WITH r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS i, COUNT(*) OVER () AS n FROM fx_lengths) SELECT idx, CAST(CAST(i >= n // 4 AS INT) + CAST(i >= 2 * n // 4 AS INT) + CAST(i >= 3 * n // 4 AS INT) AS INT) AS contiguous, CAST(i % 4 AS INT) AS strided FROM r")
def assign_batches(x: Inputs) -> DataFrame:
    a = sp.assign_batches(x.fx_lengths, ["idx"], 4).select("idx", F.col("worker").alias("contiguous"))
    return a.join(sp.assign_batches(x.fx_lengths, ["idx"], 4, "strided").select("idx", F.col("worker").alias("strided")), "idx")


@query("WITH r AS (SELECT idx, length, row_number() OVER (ORDER BY md5(idx || '-42'), idx) - 1 AS i FROM fx_lengths), s AS (SELECT idx, i // 400 AS m, row_number() OVER (PARTITION BY i // 400 ORDER BY length DESC, i) - 1 AS k FROM r) SELECT idx, m * 50 + k // 8 AS batch, CAST((m * 50 + k // 8) % 4 AS INT) AS worker FROM s")
def length_grouped_batches(x: Inputs) -> DataFrame:
    return sp.length_grouped_batches(x.fx_lengths, 8, 4).select("idx", "batch", "worker")


# --- packing and tokens -------------------------------------------------------------------------
#: Best fit in SQL: one step a row of a block, with the room left in its bins.
_PACK = """RECURSIVE o AS (SELECT idx, length, (row_number() OVER (ORDER BY idx) - 1) // 256 AS block FROM fx_lengths),
    s AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY length DESC, idx) AS k FROM o),
    r AS (SELECT DISTINCT block, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS rooms, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS length, CAST(NULL AS BIGINT) AS bin FROM s
          UNION ALL SELECT block, k, CASE WHEN spot IS NULL THEN list_append(rooms, greatest(4096, length) - length) ELSE list_transform(rooms, lambda x, j: CASE WHEN j = spot THEN x - length ELSE x END) END, idx, length, COALESCE(spot, len(rooms) + 1) - 1
          FROM (SELECT r.block, s.k, r.rooms, s.idx, s.length, list_min(list_filter(list_transform(r.rooms, lambda x, j: x * 1000 + j), lambda v: v >= s.length * 1000)) % 1000 AS spot FROM r JOIN s ON s.block = r.block AND s.k = r.k + 1)),
    packed AS (SELECT idx, length, block, bin FROM r WHERE k > 0)"""


@query(f"WITH {_PACK} SELECT idx, length, block, bin FROM packed")
def pack_sequences(x: Inputs) -> DataFrame:
    return pk.pack_sequences(x.fx_lengths)


@query(f"WITH {_PACK} SELECT block, bin, CAST(SUM(greatest(length, 1)) AS INT) AS n_tokens, CAST(MAX(greatest(length, 1)) - 1 AS INT) AS last_position, CAST(SUM(greatest(length, 1) * (greatest(length, 1) - 1) // 2) AS BIGINT) AS sum_positions FROM packed GROUP BY block, bin")
def concat_packed(x: Inputs) -> DataFrame:
    ids = F.sequence(F.lit(1), F.greatest("length", F.lit(1)).cast("int"))
    rows = pk.pack_sequences(x.fx_lengths).select("idx", "block", "bin", ids.alias("input_ids"), ids.alias("labels"), F.transform(ids, lambda v: F.lit(1.0)).alias("loss_scale"))
    out = pk.concat_packed(rows)
    return out.select("block", "bin", F.size("input_ids").alias("n_tokens"), F.array_max("position_ids").alias("last_position"), F.aggregate("position_ids", F.lit(0).cast("long"), lambda s, v: s + v).alias("sum_positions"))


def _ids() -> Column:
    return F.when(F.col("length") > 0, F.sequence(F.lit(1), F.col("length").cast("int"))).otherwise(F.array().cast("array<int>"))


@query("SELECT idx, least(length, 64) AS n_kept, nullif(length, 0) AS last_kept FROM fx_lengths UNION ALL SELECT -1 - idx, 0, NULL FROM fx_lengths WHERE idx < 10")
def truncate_tokens(x: Inputs) -> DataFrame:
    ids = _ids()
    empty = x.fx_lengths.where("idx < 10").select((-1 - F.col("idx")).alias("idx"), F.lit(0).cast("long").alias("length"))  # rows without a token
    rows = x.fx_lengths.unionByName(empty).withColumn("p", tk.take(ids, tk.truncate_tokens(ids, 64, "left")))
    return rows.select("idx", F.size("p").cast("long").alias("n_kept"), F.array_max("p").cast("long").alias("last_kept"))


@query("SELECT idx, CAST(c AS INT) AS chunk, least(length, (c + 1) * 128) - c * 128 AS n FROM fx_lengths, unnest(range(0, greatest((length + 127) // 128, 1))) t(c) UNION ALL SELECT -1 - idx, 0, 0 FROM fx_lengths WHERE idx < 10")
def split_tokens(x: Inputs) -> DataFrame:
    empty = x.fx_lengths.where("idx < 10").select((-1 - F.col("idx")).alias("idx"), F.lit(0).cast("long").alias("length"))  # stay as they are
    rows = x.fx_lengths.unionByName(empty).select("idx", _ids().alias("ids"))
    return tk.split_tokens(rows, "ids", 128).select("idx", "chunk", F.size("ids").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(l_quantity / 64.0 * 1000, 0) AS INT) AS x0, CAST(round_even(l_linenumber / 9.0 * 1000, 0) AS INT) AS y0 FROM lineitem")
def normalize_bbox(x: Inputs) -> DataFrame:
    box = tk.normalize_bbox(F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")), F.lit(64.0), F.lit(9.0))
    return x.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", box[0].alias("x0"), box[1].alias("y0"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\\.(mp4|mov)$') THEN 'video' WHEN regexp_matches(url, '(?i)\\.(jpg|png)$') THEN 'image' END AS kind FROM pages")
def media_type(x: Inputs) -> DataFrame:
    return x.pages.select("page_id", tk.media_type(F.col("url")).alias("kind"))


@query(
    """WITH m AS (SELECT p_partkey, p_partkey % 900 + 8 AS t, 200 + p_partkey % 1500 AS h, 100 + p_partkey % 2300 AS w FROM part),
    n AS (SELECT *, CAST(floor(least(least(greatest(t / 25.0 * 2, 4), 768, t), greatest(least(768, floor(t / 2.0) * 2), 4)) / 2) * 2 AS INT) AS n_frames, greatest(28, round_even(h / 28.0, 0) * 28) AS rh, greatest(28, round_even(w / 28.0, 0) * 28) AS rw FROM m)
    SELECT p_partkey, n_frames, CAST(rh AS INT) AS resized_height, CAST(rw AS INT) AS resized_width FROM n"""
)
def frame_plan(x: Inputs) -> DataFrame:
    rows = x.part.select("p_partkey", (F.col("p_partkey") % 900 + 8).alias("total_frames"), F.lit(25.0).alias("video_fps"), (200 + F.col("p_partkey") % 1500).alias("height"), (100 + F.col("p_partkey") % 2300).alias("width"))
    return tk.frame_plan(rows).select("p_partkey", "n_frames", "resized_height", "resized_width")


@query("SELECT event_id, CAST(greatest(0, least(e1, e2) - greatest(s1, s2)) AS INT) AS overlap, round(CASE WHEN greatest(e1, e2) > least(s1, s2) THEN CAST(greatest(0, least(e1, e2) - greatest(s1, s2)) AS DOUBLE) / (greatest(e1, e2) - least(s1, s2)) ELSE 0 END, 6) AS iou FROM (SELECT r.event_id, r.start_ds AS s1, r.end_ds AS e1, p.start_ds AS s2, p.end_ds AS e2 FROM fx_raw_segments r JOIN fx_pred_raw p ON r.event_id = p.event_id)")
def interval_scores(x: Inputs) -> DataFrame:
    r = x.fx_raw_segments.select("event_id", F.col("start_ds").alias("a"), F.col("end_ds").alias("b"))
    j = r.join(x.fx_pred_raw.select("event_id", F.col("start_ds").alias("c"), F.col("end_ds").alias("d")), "event_id")
    ends = [F.col(c) for c in "abcd"]
    return rounded(j.select("event_id", interval_overlap(*ends).cast("int").alias("overlap"), interval_iou(*ends).alias("iou")), "iou")


@query("SELECT event_id, round_even(value, 1) AS t FROM events")
def round_time_query(x: Inputs) -> DataFrame:
    return x.events.select("event_id", round_time(F.col("value")).alias("t"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) > 0 THEN len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) ELSE length(trim(text)) // 2 END AS n_words FROM documents")
def word_counts(x: Inputs) -> DataFrame:
    return x.documents.select("doc_id", word_count(F.col("text")).alias("n_words"))


@query("WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS t FROM documents), u AS (SELECT doc_id, CASE WHEN doc_id % 10 IN (3, 4) OR doc_id % 10 = 8 THEN CAST([] AS VARCHAR[]) ELSE t END AS t FROM t) SELECT a.doc_id, round(CASE WHEN len(a.t) = 0 AND len(b.t) = 0 THEN 1 WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS jaccard FROM u a JOIN u b ON b.doc_id = a.doc_id + 1")
def jaccard_neighbours(x: Inputs) -> DataFrame:
    """Texts of some ids count as empty, so that one or both sets of a pair are."""
    blank = (F.col("doc_id") % 10).isin(3, 4, 8)
    t = x.documents.select("doc_id", token_set(F.when(blank, "").otherwise(F.col("text"))).alias("t"))
    j = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id")
    return rounded(j.select("doc_id", jaccard(F.col("t"), F.col("u")).alias("jaccard")), "jaccard")


# --- metrics ------------------------------------------------------------------------------------
@query("SELECT round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std, MIN(length) AS min, MAX(length) AS max, COUNT(length) AS size FROM fx_lengths")
def length_stats(x: Inputs) -> DataFrame:
    return rounded(mt.length_stats(x.fx_lengths, "length"), "mean", "std")


@query("SELECT round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std, MIN(length) AS min, MAX(length) AS max, COUNT(length) AS size FROM (SELECT length FROM fx_lengths ORDER BY md5(idx || '-42'), idx LIMIT 150)")
def length_stats_sample(x: Inputs) -> DataFrame:
    """Of a uniform sample of 150 rows."""
    return rounded(mt.length_stats(x.fx_lengths, "length", sample=150), "mean", "std")


@query("SELECT idx, length FROM fx_lengths WHERE length <= 512")
def max_length_filter(x: Inputs) -> DataFrame:
    return mt.max_length_filter(x.fx_lengths, 512)


@query("SELECT round(avg(CAST(p.emotion = r.emotion AS INT)), 6) AS accuracy, COUNT(*) AS n FROM fx_pred_raw p JOIN fx_raw_segments r ON p.event_id = r.event_id")
def accuracy_exact(x: Inputs) -> DataFrame:
    rows = x.fx_pred_raw.select("event_id", F.col("emotion").alias("pred")).join(x.fx_raw_segments.select("event_id", F.col("emotion").alias("label")), "event_id")
    return rounded(mt.accuracy(rows), "accuracy")


def _token_rows(x: Inputs) -> DataFrame:
    i = F.sequence(F.lit(1), F.greatest(F.col("length") % 97, F.lit(2)).cast("int"))
    return x.fx_lengths.select(F.transform(i, lambda v: (v + 1) % 7).alias("pred"), F.transform(i, lambda v: F.when(v % 5 == 0, -100).otherwise(F.when(v % 11 == 0, 99).otherwise(v % 7))).alias("label"))


_TOKENS = "tr AS (SELECT idx, i, (i + 1) % 7 AS p, lead(CASE WHEN i % 5 = 0 THEN -100 WHEN i % 11 = 0 THEN 99 ELSE i % 7 END) OVER (PARTITION BY idx ORDER BY i) AS l FROM fx_lengths, unnest(range(1, greatest(length % 97, 2) + 1)) t(i)), tv AS (SELECT idx, COUNT(*) AS n, SUM(CAST(p = l AS INT)) AS ok FROM tr WHERE l IS NOT NULL AND l <> -100 GROUP BY idx)"


@query(f"WITH {_TOKENS} SELECT round(SUM(ok) / SUM(n), 6) AS accuracy, CAST(SUM(n) AS BIGINT) AS n FROM tv")
def accuracy_token(x: Inputs) -> DataFrame:
    return rounded(mt.accuracy(_token_rows(x), "token"), "accuracy")


@query(f"WITH {_TOKENS} SELECT round(avg(CAST(n = ok AS INT)), 6) AS accuracy, COUNT(*) AS n FROM tv")
def accuracy_seq(x: Inputs) -> DataFrame:
    return rounded(mt.accuracy(_token_rows(x), "seq"), "accuracy")


@query("WITH c AS (SELECT greatest(COUNT(*) FILTER (WHERE quality = 1), 1) AS d, greatest(COUNT(*) FILTER (WHERE quality = 0), 1) AS u FROM labels) SELECT d AS desirable, u AS undesirable, round(u / d, 2) AS desirable_low, round(u / d * 1.33, 2) AS desirable_high, round(d / u / 1.33, 2) AS undesirable_low, round(d / u, 2) AS undesirable_high FROM c")
def preference_balance(x: Inputs) -> DataFrame:
    return mt.preference_balance(x.labels, "quality")


@query("SELECT COUNT(*) AS num_samples, CAST(SUM(prompt_tokens) AS BIGINT) AS num_prompt_tokens, CAST(SUM(generated_tokens) AS BIGINT) AS num_generated_tokens, round(COUNT(*) / 60.0, 6) AS samples_per_s, round(SUM(generated_tokens) / 60.0, 6) AS tokens_per_s FROM fx_requests")
def throughput_stats(x: Inputs) -> DataFrame:
    return rounded(mt.throughput_stats(x.fx_requests, 60.0), "samples_per_s", "tokens_per_s")


@query("SELECT c_nationkey AS \"group\", c_custkey AS name, loss, score, abs(COALESCE(loss, 999) - MIN(COALESCE(loss, 999)) OVER w) <= 0.000000001 AS best_loss, abs(COALESCE(score, 0) - MAX(COALESCE(score, 0)) OVER w) <= 0.000000001 AS best_score, round(100 / (c_custkey % 17 + 1), 6) AS speed FROM (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 31 % 101) / 10.0 END AS loss, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 17 % 97) / 10.0 END AS score FROM customer) WINDOW w AS (PARTITION BY c_nationkey)")
def experiment_leaderboard(x: Inputs) -> DataFrame:
    k = F.col("c_custkey")
    rows = x.customer.select(F.col("c_nationkey").alias("group"), k.alias("name"), F.when(k % 7 != 0, k * 31 % 101 / 10).alias("loss"), F.when(k % 5 != 0, k * 17 % 97 / 10).alias("score"), F.lit(100).alias("n_samples"), (k % 17 + 1).alias("train_time"))
    return rounded(mt.experiment_leaderboard(rows).drop("n_samples", "train_time"), "speed", "loss", "score")


_PAIRS = """v AS (SELECT vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS e, label FROM embeddings),
    sm AS (SELECT a.vec_id // 2 AS pair, a.label, list_dot_product(a.e, b.e) AS dot, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS cosine, -list_distance(a.e, b.e) AS euclidean,
      -list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))) AS manhattan FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""
_KINDS = ("cosine", "euclidean", "manhattan", "dot")


@query(
    f"WITH {_PAIRS}, rk AS (SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {k}) + (COUNT(*) OVER (PARTITION BY {k}) - 1) / 2.0 AS r_{k}" for k in (*_KINDS, "label")) + " FROM sm) SELECT "
    + ", ".join(f"round(corr({k}, label), 6) AS {k}_pearson, round(corr(r_{k}, r_label), 6) AS {k}_spearman" for k in _KINDS) + " FROM rk"
)
def paired_similarity_correlation(x: Inputs) -> DataFrame:
    out = mt.paired_similarity_correlation(x.embeddings)
    return rounded(out, *out.columns)


@query(
    """WITH v AS (SELECT vec_id, (vec_id * 7 + vec_id // 5) % 6 = 0 AS mark, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS e FROM embeddings),
    g AS (SELECT *, SUM(CAST(mark AS INT)) OVER (ORDER BY vec_id) AS g FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY vec_id) AS k FROM g WHERE g > 0),
    s AS (SELECT k.g, k.k, list_cosine_similarity(a.e, k.e) AS s FROM k JOIN k a ON a.g = k.g AND a.k = 1 WHERE k.k BETWEEN 2 AND 6),
    m AS (SELECT g, MAX(CASE WHEN k = 2 THEN s END) AS pos, MAX(CASE WHEN k > 2 THEN s END) AS hardest FROM s GROUP BY g)
    SELECT round(avg(pos), 6) AS mean_pos, (SELECT round(avg(s), 6) FROM s WHERE k > 2) AS mean_neg, round(avg(pos - hardest), 6) AS margin, COUNT(*) AS n_groups FROM m"""
)
def own_negatives_margin(x: Inputs) -> DataFrame:
    """Groups of vectors start where a rule on the id says so; a group's second vector is the positive, and
    up to four of the others are its negatives."""
    mark = lambda v: (v * 7 + F.floor(v / 5)) % 6 == 0
    label = F.when(mark(F.col("vec_id")), None).when(mark(F.col("vec_id") - 1), 1).otherwise(0)
    out = mt.own_negatives_margin(x.embeddings.select("vec_id", "embedding", label.alias("label")), order="vec_id", hard_negatives=4)
    return rounded(out, "mean_pos", "mean_neg", "margin")


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS e FROM embeddings),
    p AS (SELECT a.vec_id // 2 AS i, (a.vec_id // 2) // 256 AS b, a.e AS a, c.e AS p FROM v a JOIN v c ON c.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
    s AS (SELECT x.i, y.i AS j, list_cosine_similarity(x.a, y.p) AS s FROM p x JOIN p y ON x.b = y.b),
    g AS (SELECT i, MAX(CASE WHEN i = j THEN s END) AS pos, avg(CASE WHEN i <> j THEN s END) AS neg, MAX(CASE WHEN i = j THEN s END) - MAX(CASE WHEN i <> j THEN s END) AS margin FROM s GROUP BY i)
    SELECT round(avg(pos), 6) AS mean_pos, round(avg(neg), 6) AS mean_neg, round(avg(margin), 6) AS margin FROM g"""
)
def contrastive_margin(x: Inputs) -> DataFrame:
    out = mt.contrastive_margin(x.embeddings)
    return rounded(out, *out.columns)


@query(
    """WITH q AS (SELECT *, SUM(label) OVER (ORDER BY pos) AS q FROM fx_ranking), r AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY logit DESC, pos) AS r, row_number() OVER (PARTITION BY q ORDER BY label DESC, pos) AS i FROM q WHERE q > 0),
    g AS (SELECT q, COUNT(*) AS n, MIN(CASE WHEN label = 1 THEN r END) AS best, SUM((pow(2, label) - 1) / log2(r + 1)) AS dcg, SUM((pow(2, label) - 1) / log2(i + 1)) AS idcg FROM r GROUP BY q)
    SELECT round(avg(1.0 / best), 6) AS mrr, round(avg(dcg / idcg), 6) AS ndcg, COUNT(*) AS n_queries FROM g WHERE n > 1"""
)
def ranking_metrics(x: Inputs) -> DataFrame:
    return rounded(mt.ranking_metrics(x.fx_ranking), "mrr", "ndcg")


#: The pairs of texts, counts of their n-grams by side, and how many they share.
_OVERLAP = """w AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS k, {w} AS w FROM conversations),
    p AS (SELECT a.conv_id, a.turn, a.k, b.k AS kr, a.w AS p, b.w AS r FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn - 2 WHERE len(a.w) > 0 AND len(b.w) > 0),
    g AS (SELECT k, kr, n, side, g, COUNT(*) AS c FROM (SELECT k, kr, n, side, array_to_string(x[i:i + n - 1], ' ') AS g FROM (SELECT k, kr, 'p' AS side, p AS x FROM p UNION ALL SELECT k, kr, 'r', r FROM p) s, (VALUES (1), (2), (3), (4)) v(n), unnest(range(1, len(x) - n + 2)) t(i)) GROUP BY ALL),
    t AS (SELECT k, kr, n, SUM(c) AS total FROM g GROUP BY ALL),
    b AS (SELECT x.k, x.kr, x.n, SUM(least(x.c, y.c)) AS shared FROM g x JOIN g y ON x.k = y.k AND x.kr = y.kr AND x.n = y.n AND x.g = y.g AND x.side = 'p' AND y.side = 'r' GROUP BY ALL),
    f AS (SELECT t.k, t.kr, t.n, 2 * COALESCE(shared, 0) / total AS f FROM t LEFT JOIN b ON t.k = b.k AND t.kr = b.kr AND t.n = b.n)""".replace("{w}", "regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')")


@query(
    f"""WITH {_OVERLAP}
    SELECT p.conv_id, p.turn, round(COALESCE(x.f, 0), 6) AS rouge1, round(COALESCE(y.f, 0), 6) AS rouge2 FROM p LEFT JOIN f x ON x.k = p.k AND x.kr = p.kr AND x.n = 1 LEFT JOIN f y ON y.k = p.k AND y.kr = p.kr AND y.n = 2"""
)
def text_overlap_ngrams(x: Inputs) -> DataFrame:
    a = x.conversations.select("conv_id", "turn", F.col("text").alias("pred"))
    rows = a.join(a.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("pred").alias("ref")), ["conv_id", "turn"])
    return rounded(mt.text_overlap(rows).select("conv_id", "turn", "rouge1", "rouge2"), "rouge1", "rouge2")


@query(
    f"""WITH RECURSIVE {_OVERLAP},
    lcs AS (
        SELECT k, kr, 0 AS i, j, 0 AS v FROM p, unnest(range(1, len(r) + 1)) t(j)
        UNION ALL
        SELECT k, kr, i + 1, j, MAX(greatest(v, before + hit)) OVER (PARTITION BY k, kr ORDER BY j)
        FROM (SELECT l.k, l.kr, l.i, l.j, l.v, COALESCE(lag(l.v) OVER (PARTITION BY l.k, l.kr ORDER BY l.j), 0) AS before, CAST(p.p[l.i + 1] = p.r[l.j] AS INT) AS hit FROM lcs l JOIN p ON p.k = l.k AND p.kr = l.kr WHERE l.i < len(p.p))),
    longest AS (SELECT p.k, p.kr, 2.0 * MAX(v) / (len(p.p) + len(p.r)) AS f FROM p JOIN lcs l ON l.k = p.k AND l.kr = p.kr AND l.i = len(p.p) GROUP BY p.k, p.kr, p.p, p.r),
    pn AS (SELECT p.k, p.kr, v.n, COALESCE(shared, 0) AS hit, greatest(1, len(p.p) - v.n + 1) AS total, least(0, 1 - len(p.r) / len(p.p)) AS brief FROM p CROSS JOIN (VALUES (1), (2), (3), (4)) v(n) LEFT JOIN b ON b.k = p.k AND b.kr = p.kr AND b.n = v.n),
    z AS (SELECT *, COUNT(*) FILTER (WHERE hit = 0) OVER (PARTITION BY k, kr ORDER BY n) AS zeros FROM pn),
    bleu AS (SELECT k, kr, CASE WHEN MAX(CASE WHEN n = 1 THEN hit END) = 0 THEN 0 ELSE exp(SUM(ln(CASE WHEN hit > 0 THEN hit / total ELSE 1 / (pow(2, zeros) * total) END)) / 4 + MAX(brief)) END AS f FROM z GROUP BY k, kr)
    SELECT round(100 * avg(COALESCE(x.f, 0)), 6) AS rouge1, round(100 * avg(COALESCE(y.f, 0)), 6) AS rouge2, round(100 * avg(longest.f), 6) AS rougeL, round(100 * avg(bleu.f), 6) AS bleu4, COUNT(*) AS n
    FROM p LEFT JOIN f x ON x.k = p.k AND x.kr = p.kr AND x.n = 1 LEFT JOIN f y ON y.k = p.k AND y.kr = p.kr AND y.n = 2 JOIN longest ON longest.k = p.k AND longest.kr = p.kr JOIN bleu ON bleu.k = p.k AND bleu.kr = p.kr"""
)
def text_overlap_metrics(x: Inputs) -> DataFrame:
    a = x.conversations.select("conv_id", "turn", F.col("text").alias("pred"))
    rows = a.join(a.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("pred").alias("ref")), ["conv_id", "turn"])
    return rounded(mt.text_overlap_metrics(rows), "rouge1", "rouge2", "rougeL", "bleu4")


@query(
    """WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT a.user_id, a.event_id, round(SUM(b.value * pow(0.9, a.i - b.i)) / SUM(pow(0.9, a.i - b.i)), 6) AS smoothed FROM o a JOIN o b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.user_id, a.event_id"""
)
def ema_smooth(x: Inputs) -> DataFrame:
    return rounded(mt.ema_smooth(x.events, "user_id", "event_id", "value").select("user_id", "event_id", "smoothed"), "smoothed")
