"""JSON lines, keyed JSON, tables by extension, caches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, *, strict: bool = False) -> DataFrame:
    """Objects of a JSON-lines file. Blank, malformed and non-object lines are left out; ``strict`` raises."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    full = StructType([*kind.fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.where(F.json_object_keys("value").isNotNull()).select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, key: str = "video_id") -> DataFrame:
    """One JSON object keyed by id, in one or many files, as a row for each id."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias(key, "_v"))
    return each.select(key, "_v.*")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, id of a JSON list of ids."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "id"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write, or with ``append`` add, JSON lines."""
    df.write.mode(mode).json(path)


def read_dataset(spark: SparkSession, path: str, *, schema: str | None = None, columns: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """A table by its extension (jsonl, json, csv, parquet; a folder is Parquet), columns renamed."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    if schema and ext != "parquet":
        reader = reader.schema(schema)
    if ext in ("jsonl", "ndjson"):
        df = read_jsonl(spark, path, schema, strict=strict) if schema else reader.json(path)
    elif ext == "json":
        df = reader.option("multiLine", True).json(path)
    elif ext == "csv":
        df = reader.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.withColumnsRenamed(columns or {})


def ragged_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables with differing columns as one, with nulls."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def write_length_cache(df: DataFrame, path: str, length: str = "length") -> None:
    """Parquet sorted by length inside files, so that a length filter skips row groups."""
    df.sortWithinPartitions(length).write.mode("overwrite").parquet(path)


def read_length_cache(spark: SparkSession, path: str, max_length: int | None = None, length: str = "length") -> DataFrame:
    df = spark.read.parquet(path)
    return df if max_length is None else df.where(F.col(length) <= max_length)


def write_metrics_report(overall: DataFrame, per_video: DataFrame, path: str) -> None:
    """Summary and per-video metrics as JSON, without details."""
    overall.write.mode("overwrite").json(f"{path}/overall")
    per_video.drop("details").write.mode("overwrite").json(f"{path}/per_video")
