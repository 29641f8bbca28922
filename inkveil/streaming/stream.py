"""The same plans over a stream of request rows.

Every request is one source row, so a micro-batch holds all of a request's boxes and no
state or watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkveil.sources.requests import SCHEMA


def process(spark: SparkSession, source: str, sink: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``plan`` on each batch of new Parquet request files and appends its rows to ``sink``."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a batch that runs again replaces its own rows

    rows = spark.readStream.schema(SCHEMA).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
