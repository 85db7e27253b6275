"""Statistics and metrics of datasets, embeddings, rankings and texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import words
from ..sources.shared import stored
from .judging import last_wins
from .places import prefix_sums, with_row_index
from .sampling import bottom_k


#: A value that more than one row in this many holds is hot.
HOT = 1000


def length_stats(df: DataFrame, col: str, *, sample: int | None = None, id_: str = "idx", seed: int = 42) -> DataFrame:
    """Mean, population deviation, least, greatest and number of lengths; with ``sample``, of a uniform
    sample of at most so many rows (:func:`bottom_k`)."""
    rows, c = df if sample is None else bottom_k(df, sample, id_=id_, seed=seed), F.col(col)
    return rows.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("size"))


def max_length_filter(df: DataFrame, max_length: int, col: str = "length") -> DataFrame:
    """Rows whose length, or greatest length of a list, is at most ``max_length``."""
    is_list = df.schema[col].dataType.typeName() == "array"
    return df.where((F.array_max(col) if is_list else F.col(col)) <= max_length)


def accuracy(df: DataFrame, strategy: str = "exact") -> DataFrame:
    """``exact``: share of pred = label. ``token`` and ``seq``: pred and label are arrays, the label
    shifted by one and -100 ignored; share of tokens, or of rows with all of them right."""
    if strategy == "exact":
        return df.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    shifted = F.zip_with(F.slice("pred", 1, F.greatest(F.size("pred") - 1, F.lit(0))), F.slice("label", 2, F.greatest(F.size("label") - 1, F.lit(0))), lambda p, t: F.when(t != -100, p == t))
    seen = F.filter(shifted, lambda x: x.isNotNull())
    rows = df.select(F.size(seen).alias("n"), F.size(F.filter(seen, lambda x: x)).alias("ok")).where("n > 0")
    if strategy == "seq":
        return rows.agg(F.avg((F.col("n") == F.col("ok")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return rows.agg((F.sum("ok") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def preference_balance(df: DataFrame, label: str, desirable_weight: float = 1.0, undesirable_weight: float = 1.0) -> DataFrame:
    """Counts of both labels (1 at least) and the ranges of weights that balance them."""
    n = df.agg(F.greatest(F.count_if(F.col(label) == 1), F.lit(1)).alias("desirable"), F.greatest(F.count_if(F.col(label) == 0), F.lit(1)).alias("undesirable"))
    d, u = F.col("desirable"), F.col("undesirable")
    return n.select(
        "desirable", "undesirable", F.round(u * undesirable_weight / d, 2).alias("desirable_low"), F.round(u * undesirable_weight / d * 1.33, 2).alias("desirable_high"),
        F.round(d * desirable_weight / u / 1.33, 2).alias("undesirable_low"), F.round(d * desirable_weight / u, 2).alias("undesirable_high"),
    )


def throughput_stats(requests: DataFrame, runtime: float, order: str = "ts") -> DataFrame:
    """Token sums over distinct requests (the last value of each) and rates over ``runtime`` seconds."""
    one = last_wins(requests.select("request_id", order, "prompt_tokens", "generated_tokens"), ["request_id"], order)
    s = one.agg(F.count("*").alias("num_samples"), F.sum("prompt_tokens").alias("num_prompt_tokens"), F.sum("generated_tokens").alias("num_generated_tokens"))
    return s.withColumns({"samples_per_s": F.col("num_samples") / runtime, "tokens_per_s": F.col("num_generated_tokens") / runtime})


def experiment_leaderboard(df: DataFrame, low: Sequence[str] = ("loss",), high: Sequence[str] = ("score",)) -> DataFrame:
    """Runs (group, name, metric columns, n_samples, train_time) with best_… marks of the rows equal to
    the group's best (missing ones count 999 or 0) and the speed."""
    by, out = Window.partitionBy("group"), df
    for c in low:
        x = F.coalesce(c, F.lit(999.0))
        out = out.withColumn(f"best_{c}", F.abs(x - F.min(x).over(by)) <= 1e-9)
    for c in high:
        x = F.coalesce(c, F.lit(0.0))
        out = out.withColumn(f"best_{c}", F.abs(x - F.max(x).over(by)) <= 1e-9)
    return out.withColumn("speed", F.try_divide(F.col("n_samples"), F.col("train_time")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def paired_similarities(df: DataFrame, id_: str = "vec_id") -> DataFrame:
    """pair, label and four similarities of rows 2k and 2k + 1 (id, embedding, label)."""
    a = df.where(F.col(id_) % 2 == 0).select(F.floor(F.col(id_) / 2).alias("pair"), F.col("embedding").alias("a"), "label")
    b = df.where(F.col(id_) % 2 == 1).select(F.floor(F.col(id_) / 2).alias("pair"), F.col("embedding").alias("b"))
    j = a.join(b, "pair")
    x, y = F.col("a"), F.col("b")
    diff = F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
    add = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, v: s + f(v))
    return j.select("pair", "label", (_dot(x, y) / F.sqrt(_dot(x, x) * _dot(y, y))).alias("cosine"), (-F.sqrt(add(diff, lambda v: v * v))).alias("euclidean"), (-add(diff, F.abs)).alias("manhattan"), _dot(x, y).alias("dot"))


def average_ranks(long_: DataFrame) -> DataFrame:
    """``long_`` (kind, value and more) plus rank: from 1 inside each kind, equal values sharing the mean
    of theirs. All kinds are ranked in one global order of their distinct values. The few values that a
    share of the rows holds (fewer than ``HOT`` times the kinds) are broadcast, the others joined."""
    long_ = stored(long_, "values")
    counts = stored(long_.groupBy("kind", "value").agg(F.count("*").alias("_n")), "counts")
    upto = prefix_sums(with_row_index(counts, ["kind", "value"], "_i"), "_i", "_n", "_upto")
    of_kind = upto.groupBy("kind").agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_all"))  # one row a kind
    mean = F.col("_upto") - F.col("_before") - F.col("_n") + (F.col("_n") + 1) / 2
    ranks = upto.join(F.broadcast(of_kind), "kind").select("kind", "value", mean.alias("rank"), (F.col("_n") * HOT > F.col("_all")).alias("_hot"))
    met = long_.join(F.broadcast(ranks.where("_hot").select("kind", "value", F.col("rank").alias("_r"))), ["kind", "value"], "left")
    cold = met.where("_r is null").drop("_r").join(ranks.where("not _hot").drop("_hot"), ["kind", "value"])
    return met.where("_r is not null").withColumnRenamed("_r", "rank").unionByName(cold)


def paired_similarity_correlation(df: DataFrame, id_: str = "vec_id") -> DataFrame:
    """One row: Pearson and Spearman correlation of each similarity with the label."""
    kinds = ("cosine", "euclidean", "manhattan", "dot")
    sims = paired_similarities(df, id_)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("value")) for k in (*kinds, "label"))))
    ranked = average_ranks(sims.select("pair", each.alias("e")).select("pair", "e.*"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = ranked.groupBy("pair").agg(*(of(k, c).alias(f"{k}_{c}") for k in (*kinds, "label") for c in ("value", "rank")))
    return wide.agg(
        *(F.corr(f"{k}_value", "label_value").alias(f"{k}_pearson") for k in kinds), *(F.corr(f"{k}_rank", "label_rank").alias(f"{k}_spearman") for k in kinds)
    )


def contrastive_margin(df: DataFrame, batch: int = 256) -> DataFrame:
    """One row: mean similarity of anchors (even ids) to their positives (next odd ids), to the other
    positives of their batch, and mean margin over the hardest of these. Batches are multiplied
    inside tasks and never larger than ``batch`` pairs."""
    pairs = df.select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), "embedding").groupBy("pair").agg(
        F.max(F.when(F.col("side") == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("embedding"))).alias("p")
    ).where("a is not null and p is not null").withColumn("b", F.floor(F.col("pair") / batch))

    def margins(frame: pd.DataFrame) -> pd.DataFrame:
        a, p = (np.stack(frame[c].to_numpy()).astype(float) for c in ("a", "p"))
        a, p = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, p))
        s = a @ p.T
        pos, off = np.diag(s), s[~np.eye(len(s), dtype=bool)].reshape(len(s), -1)
        none = off.shape[1] == 0
        return pd.DataFrame({"pos": pos, "neg": np.nan if none else off.mean(1), "margin": np.nan if none else pos - off.max(1)})

    rows = pairs.groupBy("b").applyInPandas(margins, "pos double, neg double, margin double")
    known = lambda c: F.avg(F.nanvl(c, F.lit(None).cast("double")))
    return rows.agg(F.avg("pos").alias("mean_pos"), known("neg").alias("mean_neg"), known("margin").alias("margin"))


def own_negatives_margin(df: DataFrame, *, order: str = "pos", hard_negatives: int | None = None) -> DataFrame:
    """One row: mean similarity of anchors to their positives, to their own negatives, and mean margin over
    the hardest of these.

    Rows (the order column, embedding, label) come in groups: an anchor, whose label is null, its positive
    (label 1) and any number of negatives (label 0), of which the first ``hard_negatives`` count, if given.
    A row's group is the number of anchors up to it, which a scan over all rows gives. Rows before the
    first anchor and groups without a positive are left out; a group without negatives has no margin.
    """
    at = with_row_index(df.select(order, "embedding", "label"), [order], "_at").withColumn("_mark", F.col("label").isNull().cast("long"))
    rows = prefix_sums(at, "_at", "_mark", "_g").where("_g > 0")
    first = rows.groupBy("_g").agg(F.min_by("embedding", "_at").alias("a"), F.min(F.when(F.col("label") == 1, F.struct("_at", "embedding"))).alias("p"))
    groups = first.where("p is not null").select("_g", "a", F.col("p.embedding").alias("p"), F.col("p._at").alias("_from"))
    # negatives follow their positive without a gap, so places count them
    near = rows.where("label = 0").join(groups.select("_g", "a", "_from"), "_g")
    if hard_negatives is not None:
        near = near.where(F.col("_at") - F.col("_from") <= hard_negatives)
    cosine = lambda x, y: _dot(x, y) / F.greatest(F.sqrt(_dot(x, x) * _dot(y, y)), F.lit(1e-12))
    neg = near.withColumn("s", cosine(F.col("a"), F.col("embedding"))).groupBy("_g").agg(F.max("s").alias("hardest"), F.sum("s").alias("s"), F.count("s").alias("n"))
    each = groups.select("_g", cosine(F.col("a"), F.col("p")).alias("pos")).join(neg, "_g", "left")
    return each.agg(F.avg("pos").alias("mean_pos"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean_neg"), F.avg(F.col("pos") - F.col("hardest")).alias("margin"), F.count("*").alias("n_groups"))


def ranking_metrics(df: DataFrame, order: str = "pos") -> DataFrame:
    """One row: MRR and NDCG over query groups, each of which starts at a label of 1; groups of one row
    and rows before the first positive are left out."""
    at = with_row_index(df, [order])
    q = prefix_sums(at, "row_idx", "label", "q").where("q > 0")
    down = Window.partitionBy("q").orderBy(F.desc("logit"), "row_idx")
    ideal = Window.partitionBy("q").orderBy(F.desc("label"), "row_idx")
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    r = q.withColumns({"r": F.row_number().over(down), "i": F.row_number().over(ideal)})
    g = r.groupBy("q").agg(F.count("*").alias("n"), F.min(F.when(F.col("label") == 1, F.col("r"))).alias("best"), F.sum(gain / F.log2(F.col("r") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("i") + 1)).alias("idcg"))
    return g.where("n > 1").agg(F.coalesce(F.avg(1 / F.col("best")), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg(F.try_divide("dcg", "idcg")), F.lit(0.0)).alias("ndcg"), F.count("*").alias("n_queries"))


def _rouge_n(p: list[str], r: list[str], n: int) -> float:
    """F1 of word n-grams with their counts."""
    a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (p, r))
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. Column by column of the usual table, which differs from
    its neighbour in single steps: these are the zero bits of one integer, and a word's column takes one
    addition of the integer with the bits at which the word stands in ``b``."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(b)) - 1
    steps = whole
    for w in a:
        if w in places:
            at = steps & places[w]
            steps = ((steps + at) | (steps - at)) & whole
    return len(b) - steps.bit_count()


def _bleu(p: list[str], r: list[str]) -> float:
    """Sentence BLEU of up to 4-grams; the k-th empty precision in turn counts as 1 / (2^k * total)."""
    if not p:
        return 0.0
    logs, zeros = 0.0, 0
    for n in range(1, 5):
        a = Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
        b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hit, total = sum(min(c, b[g]) for g, c in a.items()), max(1, len(p) - n + 1)
        if not hit:
            if n == 1:
                return 0.0
            zeros += 1
        logs += math.log(hit / total if hit else 1 / (2**zeros * total)) / 4
    return math.exp(logs + min(0.0, 1 - len(r) / len(p)))


def text_overlap(df: DataFrame) -> DataFrame:
    """``df`` (with pred and ref) plus rouge1, rouge2, rougeL and bleu4; pairs with an empty side go."""
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for preds, refs in frames:
            out = []
            for p, r in zip(map(list, preds), map(list, refs), strict=True):
                both = _lcs(p, r)
                out.append((_rouge_n(p, r, 1), _rouge_n(p, r, 2), 2 * both / (len(p) + len(r)), _bleu(p, r)))
            yield pd.DataFrame(out, columns=["rouge1", "rouge2", "rougeL", "bleu4"])

    run.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    scores = F.pandas_udf(run, "rouge1 double, rouge2 double, rougeL double, bleu4 double")
    full = df.where((F.size(words(F.col("pred"))) > 0) & (F.size(words(F.col("ref"))) > 0))
    scored = full.withColumn("_s", scores(words(F.lower("pred")), words(F.lower("ref"))))
    return scored.withColumns({c: F.col(f"_s.{c}") for c in ("rouge1", "rouge2", "rougeL", "bleu4")}).drop("_s")


def text_overlap_metrics(df: DataFrame) -> DataFrame:
    """One row of means, times 100."""
    return text_overlap(df).agg(*[(F.avg(c) * 100).alias(c) for c in ("rouge1", "rouge2", "rougeL", "bleu4")], F.count("*").alias("n"))


def ema_smooth(df: DataFrame, key: str, order: str, value: str, smooth: float = 0.9) -> DataFrame:
    """Adds smoothed: the debiased exponential average of each series, by blocks of rows.

    Rows get their place in the order of (key, order). Inside a block the average is a sum weighted by
    powers of ``smooth``; the blocks before add theirs by weights that fall below any double after
    ``reach`` blocks. So no task holds a series, however long. A null value counts 0.
    """
    fall = -math.log(smooth)
    block, reach = max(256, math.ceil(25 / fall)), math.ceil(745 / (max(256, math.ceil(25 / fall)) * fall)) + 1
    rows = with_row_index(df.select(key, order, value), [key, order], "_i").withColumn("_b", F.floor(F.col("_i") / block))
    at = rows.withColumn("_l", (F.col("_i") - F.col("_b") * block).cast("double"))
    inside = Window.partitionBy(key, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    power = lambda n: F.exp(n * -fall)
    at = at.withColumn("_sum", F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * power(-F.col("_l"))).over(inside) * power(F.col("_l")))
    blocks = at.groupBy(key, "_b").agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"), F.max_by("_sum", "_i").alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_b")
    past = F.collect_list(F.struct("_last", "_total")).over(earlier.rowsBetween(-reach, -1))
    carry = F.aggregate(past, F.lit(0.0), lambda s, p: s + p["_total"] * power((F.col("_first") - 1 - p["_last"]).cast("double")))
    blocks = blocks.select(key, "_b", "_first", carry.alias("_carry"), F.min("_first").over(earlier).alias("_start"))
    out = at.join(blocks, [key, "_b"])
    total = F.col("_sum") + F.col("_carry") * power((F.col("_i") - F.col("_first") + 1).cast("double"))
    weight = (1 - power((F.col("_i") - F.col("_start") + 1).cast("double"))) / (1 - smooth)
    return out.select(key, order, value, (total / weight).alias("smoothed"))
