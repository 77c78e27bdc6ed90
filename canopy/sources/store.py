"""Readers, versioned snapshots, stage tables and the cache of provider replies."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a catalog reader gives; keys beyond it are dropped and missing ones are null.
CATALOG = "name string, signature string, doc string, id string, source string, examples array<string>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one on a single machine only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="canopy-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that lineage ends and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Items of a .jsonl file, or of a .json file that holds a list or an object with the list `tools`."""
    if path.endswith(".jsonl"):
        return spark.read.schema(CATALOG).json(path)
    if not path.endswith(".json"):
        raise ValueError("a catalog is .json or .jsonl")
    whole = spark.read.schema(f"{CATALOG}, tools array<struct<{CATALOG.replace(' string', ':string').replace(' array', ':array')}>>").option("multiLine", True).json(path)
    inner = whole.filter(F.col("tools").isNotNull()).select(F.explode("tools").alias("t")).select("t.*")
    return whole.filter(F.col("tools").isNull()).drop("tools").unionByName(inner)


#: What a file of evaluation cases gives.
CASES = "id string, difficulty string, query string, calls array<string>, success_criteria array<string>, expectations map<string,string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object a line; blank lines are skipped, keys that CASES lacks dropped and missing ones null."""
    return spark.read.schema(CASES).json(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def next_version(spark: SparkSession, root: str) -> str:
    """v and the number after the largest v<N> under root; v0 where there is none."""
    at, fs = _files(spark, root)
    if not fs.exists(at):
        return "v0"
    got = [int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName()))]
    return f"v{max(got) + 1}" if got else "v0"


def write_snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """Write the tables under the next version; an existing folder is an error. Returns its path."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{root.rstrip('/')}/{next_version(spark, root)}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return path


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def cache_key(model: str, prompt):
    return F.sha2(F.concat(F.lit(model + "::"), prompt), 256)


def shard(key, width: int = 2):
    """The first characters of a cache key, which name its folder."""
    if not 1 <= width <= 4:
        raise ValueError("a shard has 1 to 4 characters")
    return F.substring(key, 1, width)


def cached(requests: DataFrame, cache: DataFrame, call) -> tuple[DataFrame, DataFrame]:
    """(requests with their values, rows to append to the cache): hits by a join, `call` for the misses' distinct keys."""
    misses = requests.select("key", "prompt").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    new = stored(call(misses).select("key", "value"), "replies")
    return requests.join(cache.select("key", "value").unionByName(new), "key", "left"), new
