"""k-means on integers: built-in array functions find the nearest of a few literal centroids, sums of
columns move them. No Python runs on rows; a round brings k rows of sums to the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components are held within this bound, which keeps every distance in a long.
BOUND = 1 << 27


def to_integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, within +-``BOUND`` (a component of 131,072 or more at 1024)."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))))


def literal(centroid: list[int]) -> Column:
    """An array constant, as one literal."""
    return F.split(F.lit(",".join(map(str, centroid))), ",").cast("array<bigint>")


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """``distance, cluster``: the least squared Euclidean distance and the least number that has it."""

    def distance(c: list[int]) -> Column:
        return F.aggregate(F.zip_with(vector, literal(c), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, d: s + d)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


@dataclass
class Clusters:
    """Centroids, the clusters' inertias, and the vectors (v, integers) with their distance and cluster."""

    centroids: list[list[int]]
    inertia: list[int]
    assigned: DataFrame


def cluster(vectors: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3) -> Clusters:
    """``vectors`` with exactly ``dims`` finite components in ``k`` clusters.

    Centroids start as the k vectors with the least sha256 of ``seed:id``; equal ids tie by their
    components, null ids come last. A round assigns each vector to the nearest centroid and moves each
    centroid that has any to the floor of their exact mean; the last assignment follows. Vectors that are
    null, of another length or hold null, NaN or infinite components are left out; repeated rows count
    each; of fewer than k vectors each is a centroid; an empty table has no centroids and no rows. Other
    columns are left out, so their names can't clash.
    """
    # one scale of doubles: float components are widened, so that an infinite float is infinite too
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where((F.size(vector) == dims) & finite).select(F.col(id_).alias("id"), to_integers(F.col(vector), scale).alias("v"))
    kept = materialize(kept, "integers")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    centroids = [list(r["v"]) for r in kept.orderBy(name.asc_nulls_last(), "id", "v").limit(k).collect()]
    if not centroids:
        return Clusters([], [], kept.withColumns({"distance": F.lit(0).cast("bigint"), "cluster": F.lit(0)}))

    def assigned() -> DataFrame:
        return kept.select("id", "v", nearest(F.col("v"), centroids).alias("n")).select("id", "v", "n.distance", "n.cluster")

    for _ in range(rounds):
        sums = assigned().groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)])
        for r in sums.collect():  # k rows
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    inertia = [0] * len(centroids)
    for r in assigned().groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect():
        inertia[r["cluster"]] = int(r["s"])
    return Clusters(centroids, inertia, assigned())
