"""Files of hits that arrive one after the other: the batch operators, applied to each micro-batch.

The engine's own queries are batch queries; this is the incremental form of the interval union, whose state is a small
merged table in place of all hits seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.intervals import merge, union_length


class RunningUnion:
    """Keeps the merged intervals of all batches in two alternating tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys, self.last = spark, path, keys, None

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``; a batch that is sent again changes nothing, as a union with itself."""
        new = merge(batch, self.keys)
        if self.last is not None:
            new = merge(self.spark.read.parquet(self.last).unionByName(new).drop("n"), self.keys)
        where = f"{self.path}/{batch_id}"
        new.write.mode("overwrite").parquet(where)
        self.last = where

    def lengths(self) -> DataFrame:
        return union_length(self.spark.read.parquet(self.last).drop("n"), self.keys)


def watch(stream: DataFrame, union: RunningUnion, checkpoint: str):
    """Start the stream; stop the returned query when done."""
    return stream.writeStream.foreachBatch(union.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
