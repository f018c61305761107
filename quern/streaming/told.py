"""Findings told again only after a quiet time: state in the executors, kept no longer than it is needed.

The state of a fingerprint is when it was last told.  A later finding of it is
told if the quiet time has passed since, in event time.  A timer at the end of
the quiet time drops the state once the watermark has passed it, so state
follows what was told of late, not all that was ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Quiet(StatefulProcessor):
    """Rows of one key with ``at`` in microseconds: those told."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        batch = pd.concat(list(rows))
        before = last = self.last.get()[0] if self.last.exists() else None
        told = []
        for at in sorted(batch["at"]):
            if last is None or at >= last + self.quiet:
                told.append(at)
                last = at
        if last != before:
            self.last.update((last,))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.quiet) // 1000 + 1)
        yield pd.DataFrame({"fingerprint": [key[0]] * len(told), "at": told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need; the session's own choice comes back after it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def told(findings: DataFrame, quiet_seconds: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (fingerprint, ts) -> (fingerprint, ts) of those told; ``late`` is how long the watermark waits.

    Rows without fingerprint or ts are left out.  Rows that come after the
    watermark has passed them are dropped, as everywhere in event time.
    """
    rows = findings.select("fingerprint", "ts").where("fingerprint is not null and ts is not null").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    keyed = rows.withWatermark("ts", late).groupBy("fingerprint")
    out = keyed.transformWithStateInPandas(Quiet(quiet_seconds * 1_000_000), "fingerprint string, at long", "Append", "EventTime")
    return out.select("fingerprint", F.timestamp_micros("at").alias("ts"))


def run_to_end(stream: DataFrame, target: str, checkpoint: str, seconds: int = 600) -> None:
    """Write all that the stream's source has now to ``target`` as Parquet, and stop."""
    with _state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError(f"the stream did not end within {seconds} s")
