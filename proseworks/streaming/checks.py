"""Checking as a stream: the engine's stages keep no state, so they apply to streaming DataFrames as they are.

Spelling findings are decided once for each distinct word, by joins, so a stream of them goes batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from proseworks.plans.engine import Engine


def start(engine: Engine, docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Findings of a stream of documents (doc_id, text), appended to Parquet; runs over what is there, then ends."""
    found = engine.check(docs)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_all(engine: Engine, docs: DataFrame, dictionary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Findings of grammar and spelling (``Engine.check_all``) of a stream, in Parquet with a column batch; runs over what is there, then ends.

    ``dictionary`` (word, freq) is a table that stays as it is. A batch that runs again after a failure writes its own
    folder anew, so no finding stands there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # tokens and grammar both read it
        try:
            engine.check_all(batch, dictionary).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
