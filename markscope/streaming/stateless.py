"""Inspection and cleaning of streams. Both work on one row at a time, so a stream needs no state and no event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.characters import Options
from ..plans import pipeline


def clean_stream(docs: DataFrame, o: Options = Options(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return pipeline.clean_texts(docs, o, id_col, text)


def inspect_stream(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per detector as inputs arrive."""
    return pipeline.inspect_texts(docs, key, id_col, text)


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start the stream; ``sink`` gets each micro-batch."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
