"""A store fed by a stream: batches are kept by number, and the latest row of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import stores


def keep_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Starts writing a stream of store rows over what is there now.

    A batch holds one row a key and has a folder of its own, which a second try replaces:
    no row is lost or kept twice when the stream resumes.
    """

    def write(batch: DataFrame, number: int) -> None:
        stores.latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key over all batches."""
    return stores.latest(spark.read.parquet(path).drop("batch"), keys, order)
