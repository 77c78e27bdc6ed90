"""Feedback logs as streams: a fold of keyed state, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(events: DataFrame) -> DataFrame:
    """(run, key, value, revision) after each batch of a stream (run, key, value, seq): the last value of each key and how often it was set.

    State is one row a (run, key); batches that bring an older event keep the newer value.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        seq, value, n = state.get if state.exists else (-1, None, 0)
        for pdf in batches:
            n += len(pdf)
            last = pdf.loc[pdf["seq"].idxmax()]
            if last["seq"] >= seq:
                seq, value = int(last["seq"]), float(last["value"])
        state.update((seq, value, n))
        yield pd.DataFrame({"run": [key[0]], "key": [key[1]], "value": [value], "revision": [n]})

    return events.groupBy("run", "key").applyInPandasWithState(step, "run long, key string, value double, revision long", "seq long, value double, n long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str) -> None:
    """Run a stream over what is there and stop. Batches replace their own rows when they are repeated: each batch is a folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{sink}/b{batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def read_latest(spark: SparkSession, sink: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of the last batch that has each key."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(sink)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select(*keys, "s.*")


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Count and sum by window of event time; events later than `late` are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
