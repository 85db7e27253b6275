"""JSON objects inside model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "struct<segments:array<struct<start_time:string,end_time:string,start:string,end:string,emotion:string,reason:string>>>"


def is_object(text: Column) -> Column:
    """Is the text one complete JSON object?"""
    return F.json_object_keys(text).isNotNull()


def _unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def _braced(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such range."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def extract_json_object(text: Column, variant: str = "pipeline") -> Column:
    """The JSON object in a model's output as text, or null.

    ``pipeline``: without a code fence the whole text, else from the first to the last brace;
    ``evaluation``: from the first to the last brace; ``strict``: the whole text alone; ``loose``:
    from the first to the last brace, or the whole text.
    """
    whole = _unfenced(text)
    tries = {"pipeline": (whole, _braced(whole)), "evaluation": (_braced(whole),), "strict": (whole,), "loose": (_braced(whole), whole)}[variant]
    return F.coalesce(*(F.when(is_object(t), t) for t in tries))
