"""Packing: length buckets of least padding, and batches of a token budget inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import spread_rank, stored


def grid_length(n: Column) -> Column:
    """n itself up to 4,096; above, rounded up to a step of 1/2048 to 1/4096 of it. The grid bounds the histogram
    to 4,096 lengths and 2,048 for each doubling beyond, whatever the corpus."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 11, F.lit(0)))
    return (F.ceil(n / step) * step).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int, totals: np.ndarray | None = None) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding, by dynamic programming.

    Each entry is a cell of rows: its largest length, its rows and the sum of their lengths (where not given, all have
    the largest). cost(i, j) pads cells i..j-1 to lengths[j-1]; it satisfies the quadrangle inequality, so the best
    split moves right with j and each row is filled by divide and conquer.
    """
    n = len(lengths)
    if n == 0:
        return []
    c = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    s = np.concatenate([[0.0], np.cumsum(counts * lengths if totals is None else totals, dtype=float)])
    tops = np.concatenate([[0.0], lengths.astype(float)])
    prev = np.full(n + 1, np.inf)
    prev[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        cur, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        cur[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            cost = prev[i] + tops[mid] * (c[mid] - c[i]) - (s[mid] - s[i])
            k = int(np.argmin(cost))
            cur[mid], cut[mid] = cost[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        prev = cur
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65_536, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Bucket, batch and place of every row, by the length column given.

    Gives the id, the columns to carry, n_tokens (null: 0), bucket, bucket_len (what its rows are padded to), batch (gapless in a bucket) and
    place (in the batch). A batch holds floor(budget / bucket_len) rows, one at least, so padded tokens stay in the
    budget unless one row alone exceeds it. The histogram covers all rows; bucket_len is the longest row of the bucket.
    Bounds are the best of those between cells of the histogram: with cuts inside cells, whose lengths differ by less
    than 1/2048, padding could be less by at most that share of the tokens of rows over 4,096. Carried columns of these
    names are left out; an empty table gives no rows; rows alike are placed in any order.
    """
    made = ["n_tokens", "bucket", "bucket_len", "batch", "place", "_len", "_top", "_rank"]
    base = docs.select(F.col(id_col), *[F.col(c) for c in carry if c not in made and c != id_col], F.coalesce(length.cast("long"), F.lit(0)).alias("_len"))
    base = stored(base.withColumn("_top", grid_length(F.col("_len"))), "lengths")
    cells = base.groupBy("_top").agg(F.max("_len").alias("most"), F.count(F.lit(1)).alias("n"), F.sum("_len").alias("all")).collect()
    cells = np.array(sorted((r["most"], r["n"], r["all"]) for r in cells), np.int64).reshape(-1, 3)
    bounds = best_bounds(cells[:, 0], cells[:, 1], buckets, cells[:, 2])
    bucket = F.lit(max(len(bounds) - 1, 0))
    bucket_len = F.lit(bounds[-1] if bounds else 0).cast("long")
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("_len") <= bounds[k], F.lit(k)).otherwise(bucket)
        bucket_len = F.when(F.col("_len") <= bounds[k], F.lit(bounds[k]).cast("long")).otherwise(bucket_len)
    base = base.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", bucket_len)
    ranked = spread_rank(base, ["bucket"], ["_len", id_col], "_rank")
    room = F.greatest(F.floor(F.lit(float(budget)) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    out = ranked.withColumn("batch", F.floor(F.col("_rank") / room).cast("long")).withColumn("place", F.pmod(F.col("_rank"), room))
    return out.withColumn("n_tokens", F.col("_len")).drop("_len", "_top", "_rank")


def padding(lengths: np.ndarray, counts: np.ndarray, bounds: list[int]) -> int:
    """Padded minus real tokens under the bounds."""
    top = np.asarray(bounds)[np.searchsorted(bounds, lengths)]
    return int(((top - lengths) * counts).sum())
