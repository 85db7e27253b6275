"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: a folder of this application in ``spark.checkpoint.dir``,
    which every executor shares.

    Where the session has none and all runs on one machine (tests), a new folder under the system's
    temp folder is made once per process; on a cluster that is an error, as tables would be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_root[0]


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Table:
    """A DataFrame written as Parquet to the shared scratch folder, so that its lineage is cut."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read ``df`` after this."""
        _delete(self.spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A table that a result reads: it stays until :func:`clear`."""
    return Table(df, name).df


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has left; results that read them end with them."""
    _delete(spark, scratch_root(spark))


class Scratch:
    """The intermediate tables of one call, dropped when their readers are done, at the block's end
    at the latest. Calls in other threads have tables of their own."""

    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.done(name)
        self.tables[name] = Table(df, name)
        return self.tables[name].df

    def done(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.tables.pop(name).drop()

    def __exit__(self, *_: object) -> None:
        self.done(*self.tables)


def bit_set(places: DataFrame, n_bits: int) -> np.ndarray:
    """One bit for each of the ``n_bits`` places (column p, from 0) that occurs, packed by eight;
    ``n_bits / 8`` bytes reach the driver at most."""
    ones = places.select((F.col("p") + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
    bits = np.zeros(n_bits // 8 + 4096, np.uint8)
    for r in ones.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect():
        start = (r["b"] - 1) * 4096
        bits[start : start + 4096] |= np.frombuffer(bytes(r["m"]), np.uint8)
    return bits


def bits_at(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def bits_for(n: int, each: int = 32) -> int:
    """Places of a bit set for ``n`` members: ``each`` to twice as many for each, 2**27 at most (16 MB)."""
    return 1 << min(27, max(15, (each * n).bit_length()))


def in_bits(bits: np.ndarray, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function: is the bit at this place set? The bits are broadcast."""
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(bits_at(shared.value, batch.to_numpy(zero_copy_only=False)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and leave every other character alone."""
    return F.translate(text, UPPER, LOWER)


#: Bytes of ASCII white space: space and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in SPACES else c for c in range(256))


def fold_ascii(text: bytes) -> bytes:
    """UTF-8 bytes with A to Z lower-cased and each ASCII white-space byte as a blank."""
    return text.translate(_FOLD)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
