"""A stream of inventory rows, upserted batch by batch into snapshots of the latest row of each path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.reuse import upserted


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Each batch writes a new version beside the last: version n is read only if batch n + 1 has its input."""

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        before = spark.read.parquet(f"{path}/version={number - 1}") if number else new.limit(0)
        latest = upserted(before, new, keys)  # of several rows of a key in one batch, too, the latest
        latest.write.mode("overwrite").parquet(f"{path}/version={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
