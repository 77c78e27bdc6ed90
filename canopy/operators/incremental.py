"""Incremental maintenance: what changed, and whether to rebuild all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(prev: DataFrame, new: DataFrame) -> DataFrame:
    """(name, status) of two catalogs (name, hash): added, changed, unchanged or removed. Names are distinct on each side."""
    both = prev.select("name", F.col("hash").alias("p"), F.lit(True).alias("was")).join(new.select("name", F.col("hash").alias("n"), F.lit(True).alias("now")), "name", "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("p").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return both.select("name", status.alias("status"))


def decide(changes: DataFrame, share: float = 0.3) -> DataFrame:
    """One row of counts; a full rebuild where nothing is there or the share of what is not unchanged reaches `share`."""
    c = changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed", "unchanged")])
    moved = F.col("added") + F.col("changed") + F.col("removed")
    return c.withColumn("full_rebuild", (moved + F.col("unchanged") == 0) | (F.try_divide(moved, moved + F.col("unchanged")) >= share))
