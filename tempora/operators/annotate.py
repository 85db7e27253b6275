"""Requests to models, their answers, and user-supplied batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import extract_json_object
from .timeline import previous_segment_context

PAIRS = "struct<candidate_pairs:array<struct<emotion:string,reason:string>>,selected_pair_index:string,emotion:string,reason:string>"
N_PAIRS = 4
# Our own prompt texts.
PROMPTS = {
    "describe": "Describe what happens from {start} s to {end} s. Before: {prev}",
    "reason": "Why does a viewer feel as they do from {start} s to {end} s? Before: {prev}",
    "judge": "Rate the annotation of {start} s to {end} s from 0 to 5. Before: {prev}",
}


def build_requests(segments: DataFrame, kind: str) -> DataFrame:
    """A request for each segment: request_id, video_id, seg_idx, kind, media range and prompt, which
    tells of the segment before."""
    s = previous_segment_context(segments, ("start_ds", "end_ds", "emotion"))
    second = lambda c: F.format_string("%.1f", F.col(c) / 10)
    prev = F.when(F.col("prev_end_ds").isNull(), "nothing").otherwise(F.concat(F.coalesce("prev_emotion", F.lit("unknown")), F.lit(" until "), second("prev_end_ds"), F.lit(" s")))
    text = F.lit(PROMPTS[kind])
    for name, value in (("start", second("start_ds")), ("end", second("end_ds")), ("prev", prev)):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return s.select(F.concat_ws("-", "video_id", "seg_idx").alias("request_id"), "video_id", "seg_idx", F.lit(kind).alias("kind"), "start_ds", "end_ds", text.alias("prompt"))


def build_video_requests(videos: DataFrame) -> DataFrame:
    """A request for each whole video."""
    prompt = F.format_string("Split this video of %.1f s into segments of one emotion each.", F.col("dur_ds") / 10)
    return videos.select(F.col("video_id").cast("string").alias("request_id"), "video_id", F.lit("segment").alias("kind"), F.lit(0).alias("start_ds"), F.col("dur_ds").cast("int").alias("end_ds"), prompt.alias("prompt"))


def parse_reason_output(df: DataFrame, column: str = "output") -> DataFrame:
    """Adds candidate_pairs (four, the last repeated), selected_pair_index (0 to 3), emotion, reason (the
    answer's own or the selected pair's), parse_error and raw_text of what is no JSON object."""
    text = extract_json_object(F.col(column))
    out = df.withColumn("_o", F.from_json(text, PAIRS))
    pairs = F.slice(F.coalesce("_o.candidate_pairs", F.array().cast("array<struct<emotion:string,reason:string>>")), 1, N_PAIRS)
    empty = F.struct(F.lit("").alias("emotion"), F.lit("").alias("reason"))
    last = F.coalesce(F.try_element_at(pairs, F.lit(-1)), empty)
    padded = F.concat(pairs, F.array_repeat(last, F.lit(N_PAIRS) - F.size(pairs)))
    at = F.least(F.greatest(F.coalesce(F.col("_o.selected_pair_index").try_cast("int"), F.lit(0)), F.lit(0)), F.lit(N_PAIRS - 1))
    out = out.withColumns({"candidate_pairs": padded, "selected_pair_index": at, "parse_error": text.isNull()})
    pick = lambda f: F.coalesce(F.nullif(F.trim(f"_o.{f}"), F.lit("")), F.get("candidate_pairs", F.col("selected_pair_index"))[f])
    return out.withColumns({"emotion": pick("emotion"), "reason": pick("reason"), "raw_text": F.when(F.col("parse_error"), F.col(column))}).drop("_o")


def parse_conversation_answer(df: DataFrame, turn: str = "second") -> Column:
    """The answer's text: of the second turn, or of the last of gpt. ``df`` has conversations
    (from, value)."""
    c = F.col("conversations")
    if turn == "second":
        return F.get(c, F.lit(1))["value"]
    return F.try_element_at(F.filter(c, lambda m: m["from"] == "gpt"), F.lit(-1))["value"]


def video_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def to_rl_rows(df: DataFrame, system_prompt: str, max_samples: int | None = None) -> DataFrame:
    """idx, video, duration, conversations to id, messages, videos, solution and error."""
    answer = extract_json_object(parse_conversation_answer(df, "last"))
    end = F.try_element_at(F.from_json(answer, "struct<segments:array<struct<end_time:double>>>")["segments"], F.lit(-1))["end_time"]
    duration = F.coalesce("duration", end)
    said = F.coalesce(F.format_string("%.1fs", F.nullif(duration, F.lit(0.0))), F.lit("unknown"))
    said = F.when(duration.isNull(), "unknown").otherwise(said)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    ask = F.concat(F.lit("<video>\nThe video lasts "), said, F.lit(". Annotate it."))
    error = F.when(F.coalesce("video", F.lit("")) == "", "missing video").when(answer.isNull(), "missing solution")
    rows = df.select(F.lpad(F.col("idx").cast("string"), 6, "0").alias("id"), F.array(message("system", F.lit(system_prompt)), message("user", ask)).alias("messages"), F.array("video").alias("videos"), answer.alias("solution"), error.alias("error"))
    return rows if max_samples is None else rows.orderBy("id").limit(max_samples)


def row_md5(df: DataFrame, exclude: tuple[str, ...] = ("choices",)) -> Column:
    """md5 of the row as JSON with its columns in the order of their names."""
    names = sorted(c for c in df.columns if c not in exclude)
    return F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary"))


def _asking(requests: DataFrame, fn: Callable[[pd.DataFrame], list], retries: int) -> DataFrame:
    """Adds output, error and attempts: what a user's batch function gives for the rows, each time that
    the result is read.

    ``fn`` gets a frame with the requests' columns, attempt and last_error and returns a value (or
    None) a row. Rows without a value, or whole batches that raise, are tried again up to
    ``retries`` times with the error of the time before; rows that still fail carry it.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            outputs, errors, attempts = ([x] * len(frame) for x in (None, None, 0))
            todo = list(range(len(frame)))
            for attempt in range(retries + 1):
                if not todo:
                    break
                part = frame.iloc[todo].assign(attempt=attempt, last_error=[errors[i] for i in todo])
                try:
                    values, why = list(fn(part)), "no output"
                    if len(values) != len(part):
                        raise ValueError("the function must return a value for each row")
                except Exception as e:  # a model's failure must not fail the job
                    values, why = [None] * len(part), f"{type(e).__name__}: {e}"
                for i, v in zip(todo, values, strict=True):
                    outputs[i], errors[i], attempts[i] = None if v is None else str(v), why if v is None else None, attempt + 1
                todo = [i for i in todo if outputs[i] is None]
            yield frame.assign(output=outputs, error=errors, attempts=attempts)

    return requests.mapInPandas(run, f"{schema}, output string, error string, attempts int")


def annotate_with(requests: DataFrame, fn: Callable[[pd.DataFrame], list], path: str, *, key: str | None = None, batches: int = 1, retries: int = 2) -> DataFrame:
    """Adds output, error and attempts: what a user's batch function gives for the rows, written under
    ``path``, a folder that all executors share, so that reading the result asks nothing again.

    ``fn`` gets a frame with the requests' columns, attempt and last_error and returns a value (or None) a
    row; rows that fail ``retries`` times more carry the last error. With ``key``, which tells the requests
    apart, the work can be taken up again: requests are asked in ``batches`` by a hash of the key, each
    batch is committed when it is done, and a further call asks only those without a committed output.
    What an interrupted batch asked is asked again; more batches lose less.
    """
    spark, shape = requests.sparkSession, _asking(requests.limit(0), fn, retries).schema.add("run", "long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # batches are folders of their own; one that wasn't finished has no mark of success
    done = [x.getPath() for x in files.listStatus(folder)] if files.exists(folder) else []
    done = [p.toString() for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if done and key is None:
        raise ValueError(f"{path} holds outputs; taking them up again needs a key")
    known, run = (spark.read.schema(shape).parquet(*done) if done else None), 0
    todo = requests
    if known is not None:
        run = known.agg(F.max("run")).first()[0] + 1
        keys = known.where("output is not null").select(F.col(key).alias("_key")).distinct()
        todo = requests.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    for b in range(batches):
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b) if key else todo
        _asking(part, fn, retries).withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{path}/run-{run}-{b}")
        done.append(f"{path}/run-{run}-{b}")
    got = spark.read.schema(shape).parquet(*done)
    if known is None:
        return got.drop("run")
    # a key that failed and was asked again has a row for each run
    best = got.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*shape.names), F.struct(F.col("output").isNotNull(), "run")).alias("r"))
    return best.select("r.*").drop("run")


def annotate_rounds(requests: DataFrame, fn: Callable[[pd.DataFrame], list], done: Callable[[Column], Column], path: str, *, rounds: int = 2) -> DataFrame:
    """Ask again, up to ``rounds`` times, for the rows whose output isn't done yet.

    ``fn`` also gets round (from 1) and last_output (null in the first round). Returns the requests plus
    round, output, error and attempts, each row once: as the first round that was done left it, or the
    last. Each round is written under ``path``, a new folder that all executors share, so that the
    function runs once for a row and round.
    """
    todo, out = requests.withColumn("last_output", F.lit(None).cast("string")), None
    for k in range(1, rounds + 1):
        got = _asking(todo.withColumn("round", F.lit(k)), fn, 0)
        got.write.parquet(f"{path}/round-{k}")
        got = requests.sparkSession.read.schema(got.schema).parquet(f"{path}/round-{k}")
        ok = F.coalesce(done(F.col("output")), F.lit(False))
        settled = (got if k == rounds else got.where(ok)).drop("last_output")
        out = settled if out is None else out.unionByName(settled)
        todo = got.where(~ok).select(*requests.columns, F.col("output").alias("last_output"))
        if k < rounds and todo.isEmpty():
            break
    return out
