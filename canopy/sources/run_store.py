"""Store of runs: goals, states, plan versions, artifacts and feedback as appended tables, read at their latest rows."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import _files

#: The tables and what tells the rows of a run apart. Feedback is a log: all its rows count.
KEYS = {"goal": [], "state": [], "plan": ["version long"], "artifact": ["artifact string"], "feedback": ["seq long"]}
BUCKETS = 64  # folders of a table, by a hash of the run


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def _names(kind: str) -> list[str]:
    if kind not in KEYS:
        raise ValueError(f"no such table: {kind}")
    return ["run", *(k.split()[0] for k in KEYS[kind])]


def save(kind: str, rows: DataFrame, root: str) -> None:
    """Append rows (run, the key of the table, body: JSON text) in one job, which is there as a whole or not at all.

    Nothing is overwritten: of equal keys the row written last counts, and within one call the larger body. Further columns
    are left out. A run of many rows goes to up to eight tasks, so that none holds all of it.
    """
    names = _names(kind)
    out = rows.select(*names, "body", F.lit(time.time_ns()).alias("at")).withColumn("bucket", _bucket(F.col("run")))
    part = F.pmod(F.xxhash64(*names, "body"), F.lit(8))
    out.repartition(F.col("bucket"), part).write.mode("append").partitionBy("bucket").parquet(f"{root.rstrip('/')}/{kind}")


def load(spark: SparkSession, kind: str, root: str, runs: list[str] | None = None) -> DataFrame:
    """(run, key of the table, body) of the given runs, or of all: the latest row of each key, and every row of feedback.

    Named runs read only their own folders. A table never written is empty.
    """
    names, path = _names(kind), f"{root.rstrip('/')}/{kind}"
    schema = ", ".join(["run string", *KEYS[kind], "body string", "at long", "bucket int"])
    at, fs = _files(spark, path)
    rows = spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)
    if runs is not None:
        rows = rows.filter(F.col("bucket").isin([_bucket(F.lit(r)) for r in runs]) & F.col("run").isin(runs)) if runs else rows.limit(0)
    if kind == "feedback":
        return rows.select(*names, "body")
    return rows.groupBy(*names).agg(F.max(F.struct("at", "body")).alias("last")).select(*names, "last.body")


def plan_versions(spark: SparkSession, root: str, runs: list[str] | None = None) -> DataFrame:
    """(run, versions): the versions of each run's plans, ascending."""
    return load(spark, "plan", root, runs).groupBy("run").agg(F.array_sort(F.collect_list("version")).alias("versions"))
