"""The thin queries of this subpackage, each over its whole table, and SQL for those that SQL can say."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, embedding_dedup, html_text, licenses, minhash_dedup, mixing, pii, quality, resampling, substring_dedup, url_filter
from .common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its licenses, and each finding with its span and wording differences."""
    out = licenses.summary(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_findings", "licenses", F.to_json("findings").alias("findings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, load(spark, sf_dir, "benchmark"))
    s = F.col("scan")
    return out.select(
        "doc_id",
        s["n_words"].alias("n_words"),
        s["n_hit"].alias("n_hit"),
        F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", s["items"]).cast("binary"), 256).alias("items_sha256"),
        (s["n_hit"] > 0).alias("contaminated"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each transcript made of the conversations: recovered roles, and the canonical chat.

    The model learns from all conversations whose crc32 mod 5 is not 0; ``held_out`` marks the others.
    """
    raw = chat.marked_transcripts(load(spark, sf_dir, "conversations"))
    held_out = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0
    out = chat.parsed(raw, chat.train(raw.where(F.coalesce(~held_out, F.lit(True)))))
    return out.select(
        "conv_id", "segment", "part", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_blank", F.size("roles").cast("long").alias("n_turns"), F.size("turns").cast("long").alias("n_recovered"),
        F.array_join("roles", ",").alias("roles"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("recovered"), "chat",
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extracted(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan_mix(load(spark, sf_dir, "documents"))
    return mix.taken().join(mix.sources, "i").select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = quality.scored(docs, load(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.deduplicated(docs, details=True)
    return out.select("doc_id", "original_chars", "removed_chars", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"), "text")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(load(spark, sf_dir, "documents"), shingle=2, percent=80, k=40)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. A page is labelled where its path names a labelled document."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    doc = F.expr("try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) as bigint)")
    marks = load(spark, sf_dir, "labels").where("quality in (0, 1)").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    labelled = pages.select("url", doc.alias("doc_id")).join(marks, "doc_id").select("url", "bad")
    return url_filter.judged(pages, url_filter.mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "mined")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; spans of kind ``term`` are what the corpus shows to disclose it."""
    out = pii.found(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[pii.listed(F.col("found")[k], k) for k in pii.KINDS])
    out = out.select("doc_id", "found", base.alias("base"))
    spans = F.concat("base", pii.listed(F.col("found")["term"], "term"))
    return out.select(
        "doc_id", *[F.size(F.col("found")[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"),
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if not out.centroids:
        fixed = {"cluster_inertia": F.lit(0).cast("bigint"), "inertia": F.lit(0).cast("bigint"), "centroid_sha256": F.lit("")}
    else:
        # a sum beyond a long is null
        long_ = lambda n: F.lit(n).cast("decimal(38,0)").try_cast("bigint")
        names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in out.centroids]
        of = lambda values: F.get(F.array(*values), F.col("cluster"))
        fixed = {"cluster_inertia": of([long_(n) for n in out.inertia]), "inertia": long_(sum(out.inertia)), "centroid_sha256": of([F.lit(x) for x in names])}
    return out.assigned.withColumns(fixed).select(F.col("id").alias("vec_id"), "cluster", "distance", *fixed)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resampled(docs, load(spark, sf_dir, "benchmark").select("text"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_decontaminate, op3_chat_format, op4_html_text, op5_mix, op6_quality,
        op7_substring_dedup, op8_near_dedup, op9_embedding_dedup, op10_url_filter, op11_pii, op12_centroids, op13_resampling,
    )
}

_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
    sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a, b FROM sym UNION SELECT r.a, t.b FROM reach r JOIN sym t ON r.b = t.a),
    least_id AS (SELECT a, MIN(b) AS m FROM reach GROUP BY a)"""


def _centroid_sql(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """A pair of tables a round: assignments of all vectors, then moved centroids."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"x AS MATERIALIZED (SELECT vec_id, t.d, e[t.d] AS x FROM v, unnest(range(1, {dims} + 1)) t(d))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT f.c, x.d, x.x FROM f JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (s, c)) AS c, CAST(MIN(s) AS BIGINT) AS distance FROM (SELECT x.vec_id, c.c, SUM((x.x - c.x) * (x.x - c.x)) AS s FROM x JOIN c{r} c USING (d) GROUP BY ALL) GROUP BY vec_id)")
        if r < rounds:
            moved = f"SELECT a.c, x.d, SUM(x.x) AS s, COUNT(*) AS n FROM a{r} a JOIN x USING (vec_id) GROUP BY ALL"
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, c.d, COALESCE(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x FROM c{r} c LEFT JOIN ({moved}) m USING (c, d))")
    return f"""WITH {', '.join(ctes)},
    named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(SUM(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(SUM(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
    FROM a{rounds} JOIN named USING (c)"""


#: The queries that SQL can express; tests hold the others against plain Python.
SQL: dict[str, str] = {
    "op2_decontaminate": rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
    dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(w) - n + 2)) t(k)),
    hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
    nh AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) u(p) GROUP BY doc_id),
    ni AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id""",
    "op8_near_dedup": rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, w[k] || ' ' || w[k + 1] AS s FROM d, unnest(range(1, len(w))) t(k) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
    n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
    links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
              WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * COUNT(*) >= 80 * (p.n + q.n - COUNT(*))),
    {_REACH.strip()}
    SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, least(d.doc_id, COALESCE(m, d.doc_id)) AS component_id, COALESCE(m, d.doc_id) >= d.doc_id AS kept
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_id l ON l.a = d.doc_id""",
    "op9_embedding_dedup": f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS e FROM embeddings),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
    {_REACH.strip()},
    nl AS (SELECT a, COUNT(*) AS n FROM sym GROUP BY a)
    SELECT vec_id, COALESCE(nl.n, 0) AS n_links, least(vec_id, COALESCE(m, vec_id)) AS component_id, COALESCE(m, vec_id) >= vec_id AS kept
    FROM v LEFT JOIN nl ON nl.a = vec_id LEFT JOIN least_id l ON l.a = vec_id""",
    "op12_centroids": _centroid_sql(),
    "op13_resampling": rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    tab AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    dw AS MATERIALIZED (SELECT r, unnest(w) AS x FROM d), bw AS MATERIALIZED (SELECT unnest(w) AS x FROM b),
    hex AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
    crc AS MATERIALIZED (SELECT x, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM hex, tab),
    s AS (SELECT k, COUNT(*) AS n FROM dw JOIN crc USING (x) GROUP BY k), t AS (SELECT k, COUNT(*) AS n FROM bw JOIN crc USING (x) GROUP BY k),
    tot AS (SELECT (SELECT COUNT(*) FROM dw) AS a, (SELECT COUNT(*) FROM bw) AS b),
    gain AS MATERIALIZED (SELECT s.k, CAST(floor(1000 * ln(CAST((COALESCE(t.n, 0) + 1) * (a + 10000) AS DOUBLE) / CAST((s.n + 1) * (b + 10000) AS DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), tot),
    weight AS (SELECT r, CAST(SUM(g) AS BIGINT) AS weight FROM dw JOIN crc USING (x) JOIN gain USING (k) GROUP BY r),
    score AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, COALESCE(weight, 0) AS weight,
        CAST(COALESCE(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (r)),
    ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER () AS n FROM score WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM score LEFT JOIN ranked USING (r)""",
}
