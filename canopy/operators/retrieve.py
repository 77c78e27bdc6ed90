"""Retrieval over a tree of nodes: scores, beam routing, reranking, union of pools, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vec import cosine, norm
from ..sources.store import stored
from .similarity import closest, matrix, sides

#: Rows of a block of queries or leaves.
BLOCK = 16_384

# Below these a step is weak.
LOW_SCORE, LOW_MARGIN = 0.35, 0.03


def node_scores(frontier: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """frontier (q, qv, qn, node, parent_rank, pos) with the score of each node: the larger of its own cosine and its inner
    children's. nodes: node, v, n (norm); edges: parent, child, pos, inner nodes only. Both are the tree without its leaves."""
    own = frontier.join(nodes, "node").withColumn("own", cosine(F.col("v"), F.col("qv"), F.col("n"), F.col("qn"))).drop("v", "n")
    kids = edges.select(F.col("parent").alias("node"), F.col("child")).join(nodes.withColumnRenamed("node", "child"), "child")
    best = own.join(kids, "node", "left").groupBy("q", "node").agg(F.max(cosine(F.col("v"), F.col("qv"), F.col("n"), F.col("qn"))).alias("best"))
    return own.join(best, ["q", "node"]).withColumn("score", F.greatest("own", F.coalesce("best", "own"))).drop("best")


def descend(queries: DataFrame, nodes: DataFrame, edges: DataFrame, root: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(q, parent, parent_rank) of the nodes at which the routes of the queries end, and (q, level, node) of their best nodes.

    At each level the `width` best nodes stay, ties to the better parent and the earlier child. One join a level, whatever the
    number of queries; each level's nodes are stored, so no level is worked out again. No leaf is looked at. More levels than
    the tree has inner nodes raise, as only a cycle has them.
    """
    q = queries.select("q", "qv", norm(F.col("qv")).alias("qn"))
    front = q.join(edges.filter(F.col("parent") == root)).select("q", "qv", "qn", F.col("child").alias("node"), F.lit(0).alias("parent_rank"), "pos")
    ends, path, level, most = None, None, 0, edges.count()
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "parent_rank", "pos")
    while True:
        kept = node_scores(front, nodes, edges).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= width)
        kept = stored(kept.select("q", "node", "rank"), "beam")
        if kept.isEmpty() and ends is not None:
            return ends, path
        if level > most:
            raise ValueError("the edges make a cycle")
        top = kept.filter("rank = 1").select("q", F.lit(level).alias("level"), "node")
        path = top if path is None else path.unionByName(top)
        down = kept.select("q", F.col("node").alias("parent"), F.col("rank").alias("parent_rank")).join(edges, "parent", "left")
        more = down.withColumn("more", F.max(F.col("child").isNotNull()).over(Window.partitionBy("q")))
        last = more.filter("not more").select("q", "parent", "parent_rank")
        ends = last if ends is None else ends.unionByName(last)
        front = more.filter("more and child is not null").select("q", F.col("child").alias("node"), "parent_rank", "pos").join(q, "q")
        level += 1


def ranked_leaves(ends: DataFrame, queries: DataFrame, leaves: DataFrame, k: int, few: int = 64) -> DataFrame:
    """(q, rank, leaf, score): the k best leaves (parent, pos, leaf, v, n) of the parents of each query, by their cosine, ties to
    the better parent and the earlier leaf.

    Where parents have many leaves, queries and leaves are dealt into blocks by parent, and a task multiplies two blocks and lets
    the k best of each query out: every pair is compared, but none is a row. Parents of at most `few` leaves go by a join, and so
    do vectors that are null, of a rare length or not finite, which a matrix cannot hold.
    """
    q = queries.select("q", "qv", norm(F.col("qv")).alias("qn"))
    ends = stored(ends.select("q", "parent", "parent_rank"), "ends")
    long = leaves.groupBy(F.size("v").alias("len")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "len").first()
    plain = lambda v: F.coalesce((F.size(v) == (long["len"] if long else 0)) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    asks = ends.groupBy("parent").agg(F.count(F.lit(1)).alias("asks"))
    cuts = leaves.groupBy("parent").agg(F.count(F.lit(1)).alias("has")).join(asks, "parent")
    cuts = stored(cuts.select("parent", F.ceil(F.col("asks") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("has") / BLOCK).cast("int").alias("columns"), (F.col("has") > few).alias("large")), "cuts")
    asked = ends.join(q, "q").join(cuts, "parent").withColumn("block", F.col("large") & plain(F.col("qv")))
    had = leaves.join(cuts, "parent").withColumn("block", F.col("large") & plain(F.col("v")))

    meets = lambda a, b: a.drop("rows", "columns", "block").join(b.select("parent", "leaf", "pos", "v", "n"), "parent")
    one = meets(asked.filter("not block"), had).unionByName(meets(asked.filter("block"), had.filter("not block")))
    one = one.select("q", "parent_rank", "leaf", "pos", cosine(F.col("v"), F.col("qv"), F.col("n"), F.col("qn")).alias("score"))

    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = asked.filter("block").select("parent", part("q", "rows").alias("i"), each("columns").alias("j"), F.lit(0).alias("side"), "q", "parent_rank", none(leaves, "leaf"), none(leaves, "pos"), F.col("qv").alias("v"))
    right = had.filter("block").select("parent", each("rows").alias("i"), part("leaf", "columns").alias("j"), F.lit(1).alias("side"), none(ends, "q"), none(ends, "parent_rank"), "leaf", "pos", "v")
    cells = cuts.filter("large").agg(F.sum(F.col("rows") * F.col("columns")).alias("n")).first()["n"] or 1

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(batches)
        if not (len(a) and len(b)):
            return
        b = b.sort_by("pos")
        for i, j, c in closest(matrix(a["v"]), matrix(b["v"]), k, digits=9):
            got = [a[n].take(i).combine_chunks() for n in ("q", "parent_rank")] + [b[n].take(j).combine_chunks() for n in ("leaf", "pos")]
            yield pa.RecordBatch.from_arrays([*got, pa.array(c)], names=["q", "parent_rank", "leaf", "pos", "score"])

    dealt = left.unionByName(right).repartition(int(cells), "parent", "i", "j")
    blocks = dealt.groupBy("parent", "i", "j").applyInArrow(best, one.schema)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "parent_rank", "pos")
    ranked = one.unionByName(blocks).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return stored(ranked.select("q", "rank", "leaf", "score"), "found")


def beam(queries: DataFrame, nodes: DataFrame, edges: DataFrame, leaves: DataFrame, root: int, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(q, rank, leaf, score) and (q, level, node) of routing all queries through the tree at once, whatever its depth.

    When the frontier of a query has no inner children, its leaves are ranked by their own cosine. leaves: parent, pos, leaf, v, n.
    """
    ends, path = descend(queries, nodes, edges, root, width)
    return ranked_leaves(ends, queries, leaves, k), path


def maxsim(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, rank, leaf, score): candidates (q, pos, leaf) by the largest cosine over their vectors (leaf, v); 0 without any."""
    q = queries.select("q", "qv", norm(F.col("qv")).alias("qn"))
    v = vectors.select("leaf", "v", norm(F.col("v")).alias("n"))
    s = candidates.join(q, "q").join(v, "leaf", "left").groupBy("q", "pos", "leaf").agg(F.coalesce(F.max(cosine(F.col("v"), F.col("qv"), F.col("n"), F.col("qn"))), F.lit(0.0)).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "pos")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "rank", "leaf", "score")


def union_pool(ranked: DataFrame, k: int, depth: int) -> DataFrame:
    """(q, rank, leaf, score) of the lists (q, sub, rank from 0, leaf): depth - rank, the best of a leaf, ties to the first seen."""
    best = ranked.groupBy("q", "leaf").agg(F.max(F.lit(depth) - F.col("rank")).alias("score"), F.min(F.struct("sub", "rank")).alias("seen"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "seen")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "rank", "leaf", "score")


def margins(ranked: DataFrame) -> DataFrame:
    """(q, top_score, margin) of rank 1 and 2; margin is null where there is no second."""
    top = ranked.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return top.select("q", "top_score", (F.col("top_score") - F.col("second")).alias("margin"))


def decision(expected, top, margin, many):
    """(decision, reason) of a step."""
    out = F.when(expected != 1, F.struct(F.lit("refine").alias("decision"), F.lit("expected_multi_tool_step").alias("reason")))
    for test, kind, why in ((top.isNull(), "unresolved", "no_candidates"), (top < LOW_SCORE, "refine", "low_score"), (margin < LOW_MARGIN, "refine", "low_margin"), (many, "refine", "multi_intent_text")):
        out = out.when(test, F.struct(F.lit(kind).alias("decision"), F.lit(why).alias("reason")))
    return out.otherwise(F.struct(F.lit("resolved").alias("decision"), F.lit("accepted").alias("reason")))
