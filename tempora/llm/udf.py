"""Arrow-batched functions of one text, the form most operators of this subpackage take."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string


def text_udf(ddl: str, make: Callable[[], Callable[[bytes | None], object]]) -> Callable[[Column | str], Column]:
    """A column function of a text column. ``make`` runs once a task and returns the function of one
    text (its UTF-8 bytes, or None), so that costly tables are built once."""
    kind: DataType = _parse_datatype_string(ddl)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_text = make()
        for batch in batches:
            yield pa.array([of_text(x.as_py()) for x in batch.cast(pa.binary())], arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)
