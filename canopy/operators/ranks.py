"""Numbers of rows inside groups, also where one group holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import stored


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str, rows_per_range: int = 100_000) -> DataFrame:
    """rows with their number from 0 in their group, in the order of the columns `order`, nulls first, without gaps.

    Rows are dealt into ranges of the first order column at its quantiles over all rows, so a group that holds most rows
    spreads over many tasks. Counts by (group, range) give each range its first number, and a window numbers the rows
    inside. Rows of one value of that column share a range. The first order column is a number, a date or a string;
    strings are cut by their hash of nothing but order, at sampled values.
    """
    rows = stored(rows, "numbered")
    n = rows.count()
    parts = -(-n // rows_per_range)
    at = F.lit(0)
    if parts > 1:
        first = F.col(order[0])
        if dict(rows.dtypes)[order[0]] == "string":
            some = rows.filter(first.isNotNull()).select(order[0], F.xxhash64(*order).alias("h")).orderBy("h").limit(20 * parts).select(order[0]).distinct().orderBy(order[0]).collect()
            cuts = [r[0] for r in some][19::20]
        else:
            cuts = sorted(set(rows.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.25 / parts)))
        at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= first)) if cuts else at
        at = F.when(first.isNull(), -1).otherwise(at)
    keyed = rows.withColumn("_range", at)
    key = [*group, "_range"]
    counts = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    got = inside.alias("l").join(F.broadcast(starts).alias("r") if parts < 1000 else starts.alias("r"), same)
    return got.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_start") + F.col("_in")).cast("long").alias(out))


def first_of(rows: DataFrame, group: list[str], order: str, value: str, most: int) -> DataFrame:
    """(group, items): the values of the `most` smallest order keys of each group, in order. Each task keeps `most` a group
    before the shuffle, so a group that holds most rows costs no more than others."""
    item = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    part = F.pmod(F.xxhash64(order), F.lit(256))
    w = Window.partitionBy(*group, "_p").orderBy("_i")
    few = rows.select(*group, item.alias("_i"), part.alias("_p")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    got = few.groupBy(*group).agg(F.slice(F.sort_array(F.collect_list("_i")), 1, most).alias("_is"))
    return got.select(*group, F.transform("_is", lambda x: x["v"]).alias("items"))
