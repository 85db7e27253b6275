"""URL filter by mined association rules.

A URL becomes a set of tokens. FP-growth mines the token combinations of labelled URLs; rules to the
bad label are pruned by support and confidence, and by lift: the lower bound of a rule's confidence
must be above the share of bad URLs among all, so that chance makes no rule. Rules match other URLs by
an inverted index over each rule's rarest token. Given rules of hosts and paths go first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, materialize

#: Given rules: host, path, verdict. A rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Least share of the labelled URLs that a combination occurs in, least count, and least confidence.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 5, 0.5
#: Standard deviations of the confidence's lower bound (Wilson): by chance one rule of 30,000 passes.
SURE = 4.0
#: Items of a labelled URL that are mined at most, and so the tokens of a combination: those that tell most
#: about the label. FP-growth has no bound of its own, and n items make 2**n combinations.
MAX_ITEMS = 10
#: Given rules that are expressions of the plan; more are joined.
INLINE = 64
BAD = "=bad"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path (digits as #), keys and values of the query."""
    host, rest = host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1), F.lit(""))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(
        F.split(F.regexp_replace(lower_ascii(rest), r"[0-9]+", "#"), r"(?=[?&])|[/.]"),
        lambda x: F.when(x.rlike(r"^[?&]"), F.concat(F.lit("q:"), F.substring(x, 2, 1 << 30))).otherwise(F.concat(F.lit("p:"), x)),
    )
    kept = F.filter(F.concat(labels, words), lambda x: F.length(x) > 2)
    return F.array_sort(F.array_distinct(kept))


def _told(rows: DataFrame, max_items: int) -> DataFrame:
    """``rows`` (id, tokens, bad) with the ``max_items`` tokens of each that tell most about the label: by
    the chi-square of token and label over all rows, ties by name."""
    n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    each = rows.select("id", "bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    share = n_bad / max(1, n)
    tells = F.try_divide(F.pow(F.col("k") - F.col("n") * share, F.lit(2)) * n, F.col("n") * (n - F.col("n") + 1) * (share * (1 - share) + 1e-12))
    ranked = each.join(seen.select("token", (-F.coalesce(tells, F.lit(0.0))).alias("r")), "token")
    best = ranked.groupBy("id", "bad").agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "token"))), 1, max_items).alias("t"))
    return best.select("bad", F.col("t.token").alias("tokens"))


def mine(
    labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, sure: float = SURE, max_items: int = MAX_ITEMS
) -> DataFrame:
    """Rules to the bad label: tokens (sorted), n (labelled URLs with all of them), n_bad, confidence, lift.

    ``labelled`` has url and bad (boolean). Combinations must occur ``min_count`` times at least with the
    label; rows with nulls are left out; an empty table gives no rule.
    """
    rows = labelled.where("url is not null and bad is not null").select(F.monotonically_increasing_id().alias("id"), tokens_of(F.col("url")).alias("tokens"), "bad")
    with Scratch() as scratch:
        rows = scratch(rows.where("size(tokens) > 0"), "urls")
        n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
        items = F.concat("tokens", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
        told = scratch(_told(rows, max_items).select(items.alias("items")), "items")
        none = told.select(F.col("items").alias("tokens"), *(F.lit(0).cast("long").alias(c) for c in ("n", "n_bad")), *(F.lit(0.0).alias(c) for c in ("confidence", "lift"))).limit(0)
        if not n_bad:
            return materialize(none, "rules")
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(told).freqItemsets
        sets = scratch(sets.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq"), "sets")
        counts = sets.where("size(tokens) > 0").groupBy("tokens").agg(F.max(F.when(~F.col("bad"), F.col("freq"))).alias("n"), F.max(F.when(F.col("bad"), F.col("freq"))).alias("n_bad"))
        p, m, base = F.col("n_bad") / F.col("n"), F.col("n"), n_bad / n
        low = (p + sure**2 / (2 * m) - sure * F.sqrt(p * (1 - p) / m + sure**2 / (4 * m * m))) / (1 + sure**2 / m)
        rules = counts.where("n_bad is not null").select("tokens", "n", "n_bad", p.alias("confidence"), (p / base).alias("lift")).where(p >= min_confidence).where(low > base)
        return materialize(rules, "rules")


def _given(pages: DataFrame, rules: Sequence[tuple[str, str, str]], inline: int) -> DataFrame:
    """``pages`` (with __host, __path) plus __given, the longest of the given rules that fits; of equally
    long ones the first by host and path."""
    kind = "struct<rule:string,verdict:string>"
    if len(rules) <= inline:
        fits = [
            F.when(F.col("__path").startswith(path) & ((F.col("__host") == host) | F.col("__host").endswith(f".{host}")), F.struct(F.lit(f"{host}{path}").alias("rule"), F.lit(verdict).alias("verdict")))
            for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
        ]
        return pages.withColumn("__given", F.coalesce(*fits, F.lit(None).cast(kind)))
    table = pages.sparkSession.createDataFrame(list(rules), "r_host string, r_path string, verdict string").distinct()
    places = pages.select("__host", "__path").distinct()
    labels = F.split("__host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = places.withColumn("r_host", F.explode(above)).join(table, "r_host").where(F.col("__path").startswith(F.col("r_path")))
    order = F.struct(-F.length(F.concat("r_host", "r_path")), "r_host", "r_path", "verdict")
    best = found.groupBy("__host", "__path").agg(F.min_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), order).alias("__given"))
    return pages.join(materialize(best, "given"), ["__host", "__path"], "left")


def judged(pages: DataFrame, mined: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, inline: int = INLINE) -> DataFrame:
    """``pages`` (with url) plus host, path, rule, verdict, mined (columns of these names are replaced).

    The longest given rule that fits decides; else a mined rule blocks, the most confident of which is
    ``mined`` (its tokens, joined by blanks), and all other URLs are allowed. Defined cases: a null url,
    or one without ``://``, has empty host and path, no rule and the method's verdict, allow; of equally
    long given rules the first by host and path decides; repeated rows are judged alike; an empty table
    gives an empty result.
    """
    own_names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined")]
    plain = pages.select(*own_names).toDF(*(c if c == "url" else f"__{i}" for i, c in enumerate(own_names)))
    out = plain.withColumns({"__host": host_of(F.col("url")), "__path": path_of(F.col("url")), "__tokens": tokens_of(F.col("url"))})
    out = _given(out, rules, inline)
    if mined.isEmpty():
        out = out.withColumn("__mined", F.lit(None).cast("string"))
    else:
        # written, so that the join on a frequent form of URLs has exchanges of its own, which Spark can split
        matched = _matched(out.where("__given is null").select("__tokens").distinct(), mined)
        out = out.join(matched, "__tokens", "left").withColumn("__mined", F.when(F.col("__given").isNull(), F.col("__mined")))
    verdict = F.coalesce("__given.verdict", F.when(F.col("__mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    own = [F.col(p).alias(c) for p, c in zip(plain.columns, own_names, strict=True)]
    return out.select(*own, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__given.rule").alias("rule"), verdict.alias("verdict"), F.col("__mined").alias("mined"))


def _matched(sets: DataFrame, mined: DataFrame) -> DataFrame:
    """The token sets (``__tokens``) that hold all tokens of a rule, and the most confident rule.

    The index has each rule under the token that the fewest sets hold, and tokens that no rule is
    filed under are never looked up.
    """
    with Scratch() as scratch:
        sets = scratch(sets, "sets")
        each = sets.select(F.explode("__tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        often = mined.select("tokens", "confidence", F.explode("tokens").alias("token")).join(each, "token", "left")
        index = often.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
        looked = sets.select("__tokens", F.explode("__tokens").alias("token")).join(index, "token").where(F.size(F.array_except("tokens", "__tokens")) == 0)
        best = looked.groupBy("__tokens").agg(F.max_by(F.array_join("tokens", " "), F.struct("confidence", -F.size("tokens"), F.array_join("tokens", " "))).alias("__mined"))
        return materialize(best, "matched")
