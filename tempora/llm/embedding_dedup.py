"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a random product code: pairs of unit codewords, one for each half of the
coordinates. A vector is list-decoded to all directions whose cap holds it; vectors of a label that
share a direction are compared by their cosine in double precision. The cap's height and the number
of codewords follow from how many directions a pair at the threshold must share on the average.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize
from .graph import components

#: Independent product codes, and directions that a pair at the threshold shares in all of them on
#: the average. Pairs of one code share directions by codewords in common, so that several codes
#: find more for the same number of directions; tests measure the recall at the threshold.
CODES, SHARED = 4, 32.0
#: Codewords of a half at most: 2**28 directions, enough for as many vectors of a label.
MOST_CODEWORDS = 1 << 14
#: Vectors of a part of a bucket. Larger buckets are compared part by part.
PART = 1500


def _tail(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.atleast_1d(x)])


def cap_height(n_directions: int, cosine: float, shared: float) -> float:
    """Height (in standard deviations) at which a pair of this cosine shares ``shared`` directions."""
    x = np.linspace(0, 9, 1801)

    def both(t: float) -> float:
        at = x + t
        return float(np.trapezoid(np.exp(-at * at / 2) / math.sqrt(2 * math.pi) * _tail((t - cosine * at) / math.sqrt(1 - cosine**2)), at))

    low, high = -1.0, 8.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if n_directions * both(mid) > shared else (low, mid)
    return low


def _codes(dim: int, size: int, seed: int) -> list[np.ndarray]:
    rng, halves = np.random.default_rng([seed, dim]), [(dim + 1) // 2, dim // 2]
    codes = []
    for h in halves:
        c = rng.standard_normal((size, h))
        codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))
    return codes


def _decode(unit: np.ndarray, codes: list[np.ndarray], t: float) -> list[np.ndarray]:
    """For each row the indices of all directions whose sum of half products is ``t`` or more.

    Only codewords that reach ``t`` with the best of the other half can be part of one.
    """
    h, size, out = codes[0].shape[1], len(codes[0]), []
    for a in range(0, len(unit), 128):
        u = unit[a : a + 128]
        s = [u[:, :h] @ codes[0].T, u[:, h:] @ codes[1].T] if codes[1].shape[1] else [u @ codes[0].T, np.zeros((len(u), size))]
        best = [x.max(1, keepdims=True) for x in s]
        for i in range(len(u)):
            p, q = (np.flatnonzero(s[k][i] >= t - best[1 - k][i]) for k in (0, 1))
            x, y = np.nonzero(s[0][i][p][:, None] + s[1][i][q][None, :] >= t)
            out.append(p[x] * size + q[y])
    return out


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(size: int, cosine: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height = cap_height(size * size, cosine, SHARED / CODES)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = _units(part.column("embedding"))
                found = [_decode(unit, _codes(int(dim), size, seed + r), height * math.sqrt(2 / dim)) for r in range(CODES)]
                each = [np.sort(np.concatenate([f + r * size * size for r, f in enumerate(fs)])) for fs in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(each, pa.list_(pa.int64()))], ["node", "filters"])

    return run


def _compare(cosine: float):
    """Compare the vectors of each bucket part. A pair counts in the least filter that it shares."""
    def group(rows: pa.Table) -> dict[str, np.ndarray] | None:
        unit, node, weight, c = _units(rows.column("embedding").combine_chunks()), *(rows.column(x).to_numpy() for x in ("node", "weight", "c"))
        link = unit @ unit.T >= cosine
        np.fill_diagonal(link, False)
        if rows.column("ci")[0].as_py() != rows.column("cj")[0].as_py():
            link &= c[:, None] != c[None, :]
        if not link.any():
            return None
        f = rows.column("f")[0].as_py()
        filters = rows.column("filters").combine_chunks()
        owner, flat = np.repeat(np.arange(len(rows)), np.diff(filters.offsets.to_numpy())), filters.flatten().to_numpy()
        owner, flat = owner[flat < f], flat[flat < f]
        names, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        keep = often[code] > 1
        names, code = np.unique(code[keep], return_inverse=True)
        counted = link
        for a in range(0, len(names), 2048):
            held = np.zeros((len(rows), min(2048, len(names) - a)), np.float32)
            at = (code >= a) & (code < a + 2048)
            held[owner[keep][at], code[at] - a] = 1
            counted = counted & (held @ held.T < 0.5)
        root = np.arange(len(rows))
        while True:
            least = np.minimum(root, np.where(link, root[None, :], len(rows)).min(1))
            if (least == root).all():
                break
            root = least
        return {"node": node, "links": (counted * weight[None, :]).sum(1), "root": node[root]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            starts = _starts(table)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if (out := group(table.slice(a, b - a)) if b - a > 1 else None) is not None:
                    yield pa.RecordBatch.from_pydict(out)
            rest = table.slice(starts[-1])
        if rest is not None and len(rest) > 1 and (out := group(rest)) is not None:
            yield pa.RecordBatch.from_pydict(out)

    return run


def _starts(table: pa.Table) -> np.ndarray:
    """Where the groups of equal (label, dim, f, ci, cj) start; rows are sorted by them."""
    keys = [table.column(x).to_numpy() for x in ("label", "dim", "f", "ci", "cj")]
    return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.93, part: int = PART, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine is ``cosine`` or more. n_links counts
    the other rows linked directly, component_id is the least vec_id reachable. Pairs found are
    exact; one is missed only if it shares no direction (see :data:`SHARED`; tests measure recall).
    Equal vectors of a label fold into a class first. Defined cases: rows whose vector is null,
    empty, zero or holds null or non-finite components, or whose label is null, link with nothing;
    vectors of different lengths don't link; rows that repeat a vec_id count each; a null vec_id
    counts as a link but is no component's id (its component_id may be null, kept then true); an
    empty table gives an empty result.
    """
    with Scratch() as scratch:
        return materialize(_linked(scratch, vectors, cosine, part, seed), "vectors")


def _linked(scratch: Scratch, vectors: DataFrame, cosine: float, part: int, seed: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0) & F.col("label").isNotNull(), F.lit(False))
    print_ = F.when(sound, F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), "label", x)), F.hex(F.xxhash64(F.lit(2), "label", x))))
    whole = vectors.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long" if whole else "string"), "embedding", print_.alias("print"))
    rows = scratch(rows, "vectors")
    classes = rows.where("print is not null").groupBy("print").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    nodes = scratch(classes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "classes")
    most = nodes.groupBy("label", "dim").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    size = min(MOST_CODEWORDS, 1 << max(4, math.ceil(math.log2(max(1, most * SHARED / CODES)) / 2)))
    found = scratch(nodes.select("node", "dim", "embedding").mapInArrow(_filters(size, cosine, seed), "node long, filters array<long>"), "filters")
    each = found.join(nodes.select("node", "label", "dim"), "node").select("node", "label", "dim", F.explode("filters").alias("f"))
    crowd = each.groupBy("label", "dim", "f").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("long")
    placed = each.join(crowd, ["label", "dim", "f"]).withColumn("k", parts).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    placed = placed.select("node", "label", "dim", "f", "c", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"))
    full = placed.join(nodes.select("node", "weight", "embedding"), "node").join(found, "node")
    keys = ["label", "dim", "f", "ci", "cj"]
    full = full.repartition(*keys).sortWithinPartitions(*keys)
    got = scratch(full.mapInArrow(_compare(cosine), "node long, links long, root long"), "links")
    links = got.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(got.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").distinct(), scratch)
    named = nodes.select("print", "node", "least", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    own = named.join(ids, "root").select("print", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", "print").join(own, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
