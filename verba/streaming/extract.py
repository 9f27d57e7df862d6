"""Extraction over a stream of documents: stateless, one generation per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verba.operators import ner


def start(stream: DataFrame, generation: Callable[[], tuple[DataFrame, DataFrame, ner.Pipeline]], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write spans of each micro-batch below ``path``.

    ``generation`` returns the compiled gazetteer, the dictionary forms and the
    pipeline; it is asked once per micro-batch, so a batch never mixes generations.
    A batch that runs again overwrites its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        compiled, forms, pipeline = generation()
        ner.spans(ner.extract_documents(batch, compiled, forms, pipeline)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
