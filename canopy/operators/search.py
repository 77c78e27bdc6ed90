"""Best-first search of many roots at once over a graph of scored nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import stored

ENTRY = "struct<score:double,turn:int,node:string,terminal:boolean,path:array<string>>"


def best_first(roots: DataFrame, edges: DataFrame, expansions: int = 64, width: int = 8) -> DataFrame:
    """(search, best, score, path, visited, expansions) of every row of roots (search, node, score, terminal).

    edges: parent, child, score, pos, terminal. The open entry of the largest score is expanded next, the earlier of equals,
    and gives its `width` best children, ties to the smaller pos. A search ends at a terminal entry, which is its best; with
    nothing open; or after `expansions`. Else the best is the first entry of the largest score taken. A node reached twice is
    expanded twice, and the path of an entry is the one by which it was reached. Null scores count as 0 and null terminal
    flags as false; repeated edges are children of their own; an empty roots table gives no rows.

    A search's state is one row of at most 1 + expansions * width entries. Each round joins the rows still searching with
    their node's children, at most `width`, and is stored, so the plan does not grow.
    """
    w = Window.partitionBy("parent").orderBy(F.desc("score"), "pos", "child")
    kids = edges.select("parent", "child", F.coalesce("score", F.lit(0.0)).alias("score"), "pos", F.coalesce("terminal", F.lit(False)).alias("terminal"))
    kids = kids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= width)
    kids = kids.groupBy(F.col("parent").alias("at")).agg(F.sort_array(F.collect_list(F.struct("rank", "child", "score", "terminal"))).alias("kids"))
    kids = stored(kids, "children")
    first = F.struct(F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.lit(0).alias("turn"), F.col("node").cast("string").alias("node"), F.coalesce("terminal", F.lit(False)).alias("terminal"), F.array(F.col("node").cast("string")).alias("path")).cast(ENTRY)
    none = F.array().cast("array<string>")
    state = roots.select("search", F.array(first).alias("open"), first.alias("best"), none.alias("visited"), F.lit(0).alias("n"), F.lit(1).alias("turns"), F.lit(False).alias("over"))
    state = stored(state, "search")
    for _ in range(expansions):
        going = state.filter(~F.col("over"))
        if going.isEmpty():
            break
        top = going.withColumn("top", F.array_max("open")).withColumn("at", F.col("top.node")).join(kids, "at", "left")
        fresh = F.transform(F.coalesce("kids", F.array().cast("array<struct<rank:int,child:string,score:double,terminal:boolean>>")), lambda c: F.struct(c["score"].alias("score"), (1 - F.col("turns") - c["rank"]).alias("turn"), c["child"].alias("node"), c["terminal"].alias("terminal"), F.concat(F.col("top.path"), F.array(c["child"])).alias("path")).cast(ENTRY))
        rest = F.filter("open", lambda x: x["turn"] != F.col("top.turn"))
        ends = F.col("top.terminal")
        moved = top.select(
            "search",
            F.when(ends, rest).otherwise(F.concat(rest, fresh)).alias("open"),
            F.when(ends | (F.col("top.score") > F.col("best.score")), F.col("top")).otherwise(F.col("best")).alias("best"),
            F.concat("visited", F.array("at")).alias("visited"),
            (F.col("n") + F.when(ends, 0).otherwise(1)).alias("n"),
            (F.col("turns") + F.size(fresh)).alias("turns"),
            ends.alias("over"),
        )
        moved = moved.withColumn("over", F.col("over") | (F.size("open") == 0))
        state = stored(state.filter("over").unionByName(moved), "search")
    return state.select("search", F.col("best.node").alias("best"), F.col("best.score").alias("score"), F.col("best.path").alias("path"), "visited", F.col("n").alias("expansions"))
