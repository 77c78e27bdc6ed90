"""Clustering: components, capped merging, centroids, steps of k-means and soft assignment, rebalancing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vec import norm, sq_distance
from ..sources.store import stored
from .similarity import similar_pairs


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id that each node reaches over pairs (a, b), by minimum labels and jumps along them."""
    both = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    label = stored(nodes.select("id", F.col("id").alias("cluster")), "label")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("m"))
        step = label.join(near, "id", "left").select("id", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        step = stored(step, "label")
        jump = step.select(F.col("id").alias("cluster"), F.col("cluster").alias("further"))
        new = stored(step.join(jump, "cluster").select("id", F.least("cluster", "further").alias("cluster")), "label")
        if not new.join(label.withColumnRenamed("cluster", "old"), "id").filter("cluster < old").limit(1).count():
            return new
        label = new


def capped_clusters(vectors: DataFrame, threshold: float, cap: int) -> DataFrame:
    """(id, cluster) of merging pairs by (distance, a, b) while the union has at most `cap` rows.

    Merges never cross the components of the threshold graph, so each component is merged by itself, in one task.
    """
    pairs = stored(similar_pairs(vectors, threshold), "pairs")
    parts = stored(components(vectors.select("id"), pairs), "parts")

    def merge(pdf):
        import pandas as pd

        up = {i: i for p in (pdf["a"], pdf["b"]) for i in p}
        size = dict.fromkeys(up, 1)

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for a, b in pdf.sort_values(["distance", "a", "b"])[["a", "b"]].itertuples(index=False):
            x, y = sorted((root(a), root(b)))
            if x != y and size[x] + size[y] <= cap:
                up[y], size[x] = x, size[x] + size[y]
        return pd.DataFrame({"id": list(up), "cluster": [root(i) for i in up]})

    edges = pairs.select("a", "b", (1 - F.col("cosine")).alias("distance")).join(parts.withColumnRenamed("id", "a"), "a")
    merged = edges.groupBy("cluster").applyInPandas(merge, "id long, cluster long")
    return vectors.select("id").join(merged, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def centroids(rows: DataFrame, key: str = "label", vector: str = "v") -> DataFrame:
    """(key, centroid, n): mean of each component, summed in parts before the shuffle."""
    parts = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    packed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"), F.max("n").alias("n"))
    return packed.select(key, F.transform("c", lambda s: s["m"]).alias("centroid"), "n")


def initial_centroids(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(label from 0, centroid): k of the rows (id, v) in the order of a hash of id and seed; where rows are fewer, the rest are
    normal random vectors. Without rows there are none."""
    order = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256)
    got = [[float(x) for x in r["v"]] for r in rows.filter("v is not null").orderBy(order, "id").limit(k).collect()]
    rng = np.random.default_rng(seed)
    if got:
        got += [rng.normal(size=len(got[0])).tolist() for _ in range(k - len(got))]
    return rows.sparkSession.createDataFrame(list(enumerate(got)), "label long, centroid array<double>")


def distances(rows: DataFrame, cents: DataFrame, key: str = "label", most: int = 10_000) -> DataFrame:
    """Each row (id, v) beside each centroid (k, centroid) with their squared distance d2.

    At most `most` centroids travel as one array in the plan. More are dealt into blocks by a hash, which each row meets
    by a join on the block's number, so nothing is collected and any number has its way.
    """
    got = cents.select(F.col(key).cast("long").alias("k"), "centroid")
    n = got.count()
    item = F.struct("k", "centroid")
    if n <= most:
        beside = rows.join(F.broadcast(got.agg(F.collect_list(item).alias("cs"))))
    else:
        blocks = -(-n // 1000)
        dealt = got.groupBy(F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(item).alias("cs"))
        beside = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_b")
    return beside.select(*rows.columns, F.inline("cs")).withColumn("d2", sq_distance(F.col("v"), F.col("centroid")))


def nearest(with_d2: DataFrame, keep: list[str]) -> DataFrame:
    """The nearest centroid of each id, ties to the smaller k, by a partial minimum instead of a sort."""
    return with_d2.groupBy("id").agg(F.min(F.struct("d2", "k", *keep)).alias("m")).select("id", "m.*")


def kmeans_step(rows: DataFrame, cents: DataFrame, key: str = "label") -> tuple[DataFrame, DataFrame]:
    """(assignment id, k, d2, v; new centroids k, centroid, n). A centroid without rows stays as it was."""
    assigned = nearest(distances(rows, cents, key), ["v"])
    new = centroids(assigned, "k")
    old = cents.select(F.col(key).alias("k"), F.col("centroid").alias("old"))
    return assigned, old.join(new, "k", "left").select("k", F.coalesce("centroid", "old").alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def em_refine(rows: DataFrame, cents: DataFrame, rounds: int, key: str = "label", tol: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Assignment and centroids after at most `rounds` steps; none only assigns. Ends when no centroid moves more than tol."""
    now = cents.select(F.col(key).alias("k"), "centroid")
    for _ in range(rounds):
        _, new = kmeans_step(rows, now, "k")
        new = stored(new.select("k", "centroid"), "centroids")
        moved = new.join(now.withColumnRenamed("centroid", "old"), "k").agg(F.max(F.sqrt(sq_distance(F.col("centroid"), F.col("old"))))).first()[0]
        now = new
        if moved is not None and moved <= tol:
            break
    return nearest(distances(rows, now, "k"), []), now


def soft_assign(rows: DataFrame, cents: DataFrame, alpha: float, key: str = "label") -> DataFrame:
    """(id, k, weight): softmax of -alpha * squared distance over the centroids."""
    d = distances(rows, cents, key)
    w = Window.partitionBy("id")
    e = d.withColumn("e", F.exp(-F.lit(alpha) * (F.col("d2") - F.min("d2").over(w))))
    return e.select("id", "k", "v", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def soft_step(rows: DataFrame, cents: DataFrame, alpha: float, key: str = "label") -> DataFrame:
    """(k, centroid): means weighted by the soft assignment."""
    s = soft_assign(rows, cents, alpha, key).select("k", "weight", F.posexplode("v").alias("pos", "x"))
    m = s.groupBy("k", "pos").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("m"))
    return m.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def soft_cluster(rows: DataFrame, cents: DataFrame, rounds: int, most_alpha: float, balance: float, tol: float, exponent: float = 2.0, key: str = "label") -> tuple[DataFrame, DataFrame]:
    """(labels id, k, d2; centroids k, centroid) of annealed soft clustering from the given centroids.

    Round by round the softmax sharpens from 0 to most_alpha, and centroids become weighted means. It ends where the
    shift of all centroids plus `balance` times the sum of squared shares changes by less than tol. A weight that a cluster
    of little mass gives to all its rows alike has no part in its mean, so it is not worked out. Labels are those of most_alpha:
    the nearest centroid, ties to the smaller k. With the first alpha at 0 all centroids meet in the mean of all rows.
    """
    now, before = stored(cents.select(F.col(key).cast("long").alias("k"), "centroid"), "centroids"), float("inf")
    for step in range(rounds):
        alpha = most_alpha * (step / (rounds - 1)) ** exponent if rounds > 1 else most_alpha
        s = stored(soft_assign(rows, now, alpha, "k"), "soft")
        m = s.select("k", "weight", F.posexplode("v").alias("pos", "x")).groupBy("k", "pos").agg((F.sum(F.col("weight") * F.col("x")) / (F.sum("weight") + 1e-12)).alias("m"), F.sum("weight").alias("mass"))
        new = m.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"), F.max("mass").alias("mass"))
        new = stored(new, "centroids")
        moved = new.join(now.withColumnRenamed("centroid", "old"), "k").agg(F.sum(sq_distance(F.col("centroid"), F.col("old"))).alias("shift"), F.sum("mass").alias("all"), F.sum(F.col("mass") * F.col("mass")).alias("squares")).first()
        now = new.select("k", "centroid")
        if moved["all"] is None:
            break
        goal = moved["shift"] ** 0.5 + balance * moved["squares"] / moved["all"] ** 2
        if abs(before - goal) < tol:
            break
        before = goal
    return nearest(distances(rows, now, "k"), []), now


def split_large(rows: DataFrame, cents: DataFrame, most: int, key: str = "label") -> DataFrame:
    """(id, cluster, half): each cluster over `most` rows cut once, the nearer half by (distance to the centroid, id) first."""
    if most < 1:
        raise ValueError("most must be positive")
    d = rows.join(cents.select(key, "centroid", "n"), key).withColumn("d", F.sqrt(sq_distance(F.col("v"), F.col("centroid"))))
    w = Window.partitionBy(key).orderBy(F.round("d", 9), "id")
    place = F.row_number().over(w)
    return d.select("id", F.col(key).alias("cluster"), F.when((F.col("n") > most) & (place > F.floor(F.col("n") / 2)), 1).otherwise(0).alias("half"))


def merge_small(sizes: list[tuple[int, int, list[float]]], least: int, most: int) -> dict[int, int]:
    """Where each cluster (key, rows, centroid) goes when undersized ones join the nearest with room; the sweep ends
    at the first that finds none. Works on one row a cluster."""
    live = {k: (n, c) for k, n, c in sizes}
    into = {k: k for k in live}
    while len(live) > 1:
        small = next((k for k, (n, _) in live.items() if n < least), None)
        if small is None:
            break
        n, c = live[small]
        room = [(sum((x - y) ** 2 for x, y in zip(c, oc)), i, k) for i, (k, (on, oc)) in enumerate(live.items()) if k != small and on + n <= most]
        if not room:
            break
        other = min(room)[2]
        on, oc = live[other]
        live[other] = (on + n, [(x * on + y * n) / (on + n) for x, y in zip(oc, c)])
        del live[small]
        into = {k: other if v == small else v for k, v in into.items()}
    return into


def unit(v):
    """v over its norm, which is worked out once and not for each component; v itself where it is 0."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / n)))[0]
