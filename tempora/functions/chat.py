"""Chat messages as arrays of (role, content), and texts of agents and judges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA = ("image", "video", "audio")


def dialogue_text(messages: Column) -> Column:
    """``Role: content`` lines without empty contents."""
    full = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.array_join(F.transform(full, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")


def split_last_answer(messages: Column) -> tuple[Column, Column]:
    """The messages without a last one of the assistant, and its content (null if there is none)."""
    last = F.try_element_at(messages, F.lit(-1))
    is_answer = F.coalesce(last["role"] == "assistant", F.lit(False))
    return F.when(is_answer, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages), F.when(is_answer, last["content"])


def last_user(messages: Column) -> Column:
    """Place (from 1) of the last message of the user; 0 if there is none."""
    at = F.array_position(F.transform(F.reverse(messages), lambda m: m["role"]), "user")
    return F.when(at > 0, F.size(messages) - at + 1).otherwise(0).cast("int")


def build_rejected(messages: Column, rejected: Column) -> Column:
    """The messages up to the user's last turn with the rejected answer; null if it is the one given."""
    at = last_user(messages)
    given = F.array_join(F.transform(F.slice(messages, at + 1, F.size(messages)), lambda m: m["content"]), "")
    answer = F.struct(F.lit("assistant").alias("role"), rejected.alias("content"))
    return F.when(given != rejected, F.concat(F.slice(messages, 1, at), F.array(answer)))


def to_history(messages: Column) -> Column:
    """(system, history of [query, response], valid): an odd tail has a null response; valid tells
    whether users and assistants take turns."""
    has = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    system = F.when(has, F.get(messages, F.lit(0))["content"])
    rest = F.when(has, F.slice(messages, 2, F.size(messages))).otherwise(messages)
    n = F.ceil(F.size(rest) / 2).cast("int")
    at = lambda i, k: F.get(rest, (i * 2 + k).cast("int"))["content"]
    rounds = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(rounds, lambda i: F.array(at(i, 0), at(i, 1)))
    valid = F.forall(F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: F.coalesce(x, F.lit(False)))
    return F.struct(system.alias("system"), pairs.alias("history"), valid.alias("valid"))


def flatten_content_parts(parts: Column) -> Column:
    """Parts (type, text, path) as one text with tags in place of media, and lists of their paths."""
    text = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("<"), p["type"], F.lit(">")))), "")

    def of(kind: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p["type"] == kind), lambda p: p["path"]).alias(f"{kind}s")

    paths = [of(m) for m in MEDIA]
    return F.struct(text.alias("text"), *paths)


def parse_reward_text(text: Column, variant: str = "bounded") -> Column:
    """The number after ``Reward:``; ``bounded`` takes 0 to 1 only and is null else, ``float`` any and 0 else."""
    if variant == "bounded":
        return F.nullif(F.regexp_extract(text, r"Reward:\s*([0]?\.\d+|0(?:\.\d+)?|1(?:\.0+)?)(?![\d.])", 1), F.lit("")).try_cast("double")
    return F.coalesce(F.trim(F.element_at(F.split(text, "Reward:"), -1)).try_cast("double"), F.lit(0.0))


def extract_tool_calls(text: Column) -> Column:
    """(name, arguments) of each ``<tool_call>`` object; without any, of each Action / Action Input."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    calls = F.filter(F.transform(bodies, lambda b: F.from_json(b, "struct<name:string,arguments:string>")), lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    names = F.regexp_extract_all(text, F.lit(r"Action:\s*(.*?)\s*\n\s*Action Input:"), F.lit(1))
    inputs = F.regexp_extract_all(text, F.lit(r"(?s)Action Input:\s*(.*?)\s*(?=\nObservation:|\nAction:|\z)"), F.lit(1))
    react = F.zip_with(names, F.slice(inputs, 1, F.size(names)), lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))
    return F.when(F.size(calls) > 0, calls).otherwise(react)


def loss_weights(messages: Column, strategy: str = "default") -> Column:
    """A weight for each message: ``default`` 1 for the assistant's, ``last_round`` for those after the
    user's last turn, ``all`` for every one; a message's own flag ``loss``, where it has one, wins."""
    at = last_user(messages)

    def weight(m: Column, i: Column) -> Column:
        answer = m["role"] == "assistant"
        return {"all": F.lit(1.0), "default": answer.cast("double"), "last_round": (answer & (i + 1 > at)).cast("double")}[strategy]

    return F.transform(messages, weight)


def span_weights(text: Column, table: dict[str, tuple[float, float]]) -> Column:
    """Parts (text, weight) of an agent's answer. ``table``: keyword to the weights of the keyword and
    of what follows it up to the next; text before the first keyword weighs 1."""
    keys = sorted(table, key=len, reverse=True)
    quoted = "|".join(r"\Q" + k + r"\E" for k in keys)
    pieces = F.filter(F.split(text, f"(?={quoted})|(?<={quoted})"), lambda p: p != "")
    key = F.create_map(*[F.lit(x) for k in keys for x in (k, table[k][0])])
    after = F.create_map(*[F.lit(x) for k in keys for x in (k, table[k][1])])
    before = lambda i: F.when(i > 0, F.get(pieces, i - 1))
    return F.transform(pieces, lambda p, i: F.struct(p.alias("text"), F.coalesce(F.try_element_at(key, p), F.try_element_at(after, F.coalesce(before(i), F.lit(""))), F.lit(1.0)).alias("weight")))
