"""Structured Streaming: stages that go on where they stopped, and interval statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def incremental_stage(
    spark: SparkSession, in_path: str, out_path: str, checkpoint: str, schema: StructType, transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    *, key: str | None = None, time: str | None = None, late: str = "1 hour",
) -> StreamingQuery:
    """Process the Parquet files of a folder that are new since the last run and append the results.

    The checkpoint keeps what was read, so that a restart repeats nothing. With ``key`` and ``time``, ids
    are kept in the state store over restarts: an id that comes again is left out until the watermark,
    which is ``late`` behind the latest time of the runs before, has passed the time at which it was taken
    by ``late``; rows that the watermark has passed are left out as well.
    """
    rows = spark.readStream.schema(schema).parquet(in_path)
    if key and time:
        rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return transform(rows).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def interval_throughput(stream: DataFrame, *, time: str = "ts", interval: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Requests, tokens and rates of each interval; ``stream`` has the time, prompt_tokens and
    generated_tokens. A batch table works as well."""
    width = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    g = rows.groupBy(F.window(time, interval).alias("w")).agg(F.count("*").alias("n_requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("generated_tokens").alias("generated_tokens"))
    return g.select(F.col("w.start").alias("start"), "n_requests", "prompt_tokens", "generated_tokens", (F.col("n_requests") / width).alias("requests_per_s"), (F.col("generated_tokens") / width).alias("tokens_per_s"))


def interval_usage(stream: DataFrame, *, id_: str = "request_id", time: str = "ts", interval: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Distinct requests and token sums of each interval, where a request reports its usage again and
    again and the last report of the interval counts (the greatest one of a time).

    Two states follow each other: the last report of each id in its interval, and, once the watermark has
    closed the interval, the sums over ids; both are dropped then, so that the next interval starts from
    nothing. A late report of an open interval replaces an earlier one; it is never added to it.
    """
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    report = F.struct("prompt_tokens", "generated_tokens")
    last = rows.groupBy(F.window(time, interval).alias("w"), id_).agg(F.max_by(report, F.struct(time, "generated_tokens", "prompt_tokens")).alias("r"))
    width = F.unix_timestamp(F.col("v.end")) - F.unix_timestamp(F.col("v.start"))
    g = last.groupBy(F.window(F.window_time("w"), interval).alias("v")).agg(
        F.count("*").alias("n_requests"), F.sum("r.prompt_tokens").alias("prompt_tokens"), F.sum("r.generated_tokens").alias("generated_tokens"))
    return g.select(F.col("v.start").alias("start"), "n_requests", "prompt_tokens", "generated_tokens", (F.col("n_requests") / width).alias("requests_per_s"), (F.col("generated_tokens") / width).alias("tokens_per_s"))
