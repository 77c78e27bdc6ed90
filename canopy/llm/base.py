"""What the operators share: tables, shared-folder materialisation, ranks, bounded labelled samples."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that end a word or are stripped from a line: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
#: The same, as a class for Java regular expressions.
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


def ship(name: str) -> None:
    """Pickle the module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds, as one text may have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none it is a temporary one on a single
    machine, and an error on a cluster, whose executors would each write to a disk of their own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="canopy-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and columns can be pruned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def from_fields(kind: type, fields: dict):
    """An object of the fields that `vars` gave. Broadcasts send fields, as a class in them would be looked up by name on the workers."""
    out = object.__new__(kind)
    out.__dict__.update(fields)
    return out


def per_process(key, build):
    """A value kept for the life of a Python worker, which serves many tasks. One value per kind, so it stays bounded."""
    kept = sys.__dict__.setdefault("_canopy_kept", {})
    kind, version = key
    if kept.get(kind, (None,))[0] != version:
        kept[kind] = (version, build())
    return kept[kind][1]


def let(x: Column, body) -> Column:
    """body(x) with x worked out once: array functions are not shared by the code generator."""
    return F.element_at(F.transform(F.array(x), body), 1)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the quick way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def spread_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_cell: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, also where one group holds most rows.

    Rows are dealt into cells by a hash of the order columns; counts by (group, cell) give each
    cell its first number, and a window numbers the rows inside a cell. df is stored first, so keep its
    rows narrow. The order inside a group
    is by (cell, order columns): fixed by the data, not by its partitions. Rows alike in all
    order columns share a cell and get its numbers in any order.
    """
    df = stored(df, "ranked")
    n = df.count()
    cells = max(1, -(-n // rows_per_cell)) * 16
    keyed = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    key = [*group, "_cell"]
    counts = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    inside = Window.partitionBy(*key).orderBy(*order)
    ranked = keyed.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.alias("l").join(starts.alias("r"), same).select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("_start") + F.col("_in")).cast("long").alias(out)
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_bytes: int, seed: int = 1) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most per_class rows of each class and max_bytes bytes of text a class.

    Rows are taken in the order of a hash of doc_id. Rows of null id, label or text, and labels
    other than 0 and 1, are left out. The two bounds are what lets the driver hold the sample.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    marked = marked.filter(keep).withColumn("_o", F.xxhash64(F.lit(seed), "_id"))
    picked = None
    for y in (0, 1):
        one = marked.filter(F.col("_y") == y).orderBy("_o", "_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    sizes = docs.select(F.col("doc_id").alias("_id"), F.octet_length("text").alias("_b")).filter("_b > 0")
    rows = sizes.join(F.broadcast(picked.distinct()), "_id").groupBy("_id", "_y", "_o").agg(F.min("_b").alias("_b")).collect()
    room, chosen = {0: max_bytes, 1: max_bytes}, {}
    for r in sorted(rows, key=lambda r: (r["_o"], r["_id"], r["_b"])):
        if r["_id"] not in chosen and r["_b"] <= room[r["_y"]]:
            room[r["_y"]] -= r["_b"]
            chosen[r["_id"]] = (r["_y"], r["_o"])
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "_id long")
    texts = docs.select(F.col("doc_id").alias("_id"), F.struct(F.octet_length("text").alias("b"), F.col("text").alias("t")).alias("_t")).filter("_t.b > 0")
    # Of rows that repeat an id the shortest text counts, which is the one that was measured.
    seen = {r["_id"]: r["t"]["t"] for r in texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_t").alias("t")).collect()}
    return [(i, seen[i], chosen[i][0]) for i in sorted(seen, key=lambda i: (chosen[i][1], i))]


def fit_logistic(x, y, l2: float = 1e-3, steps: int = 100):
    """Coefficients (intercept first) of a logistic regression on standardised columns, by damped Newton steps."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, ridge = np.zeros(z.shape[1]), l2 * np.eye(z.shape[1])
    ridge[0, 0] = 1e-9

    def loss(w):
        return np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).mean() + w @ ridge @ w / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) / len(y) - ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if abs(size * step).max() < 1e-8:
            break
    slope = w[1:] / scale
    return np.concatenate([[w[0] - slope @ mean], slope])


def fit_isotonic(x, y, weight):
    """Knots (x, value) of the best rising step function of x, by pooling adjacent violators; values lie inside (0, 1)."""
    import numpy as np

    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([weight[i] * y[i], weight[i], x[i], x[i]])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    total = sum(b[1] for b in blocks)
    prior = sum(b[0] for b in blocks) / total
    mean = total / len(order)
    knots = [(p, (b[0] + prior * mean) / (b[1] + mean)) for b in blocks for p in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([k for k, _ in knots]), np.maximum.accumulate(np.array([v for _, v in knots]))
