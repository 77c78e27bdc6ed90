"""Trees as tables of nodes and edges (parent, child): assembly, paths, depth, leaves, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def paths(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth, path) of every node below root, whatever the depth; the root is at depth 0.

    A level is a join with the frontier, which is stored, so the plan does not grow with the depth. A frontier that a
    path leads back into raises: edges that make a cycle are no tree.
    """
    keys = edges.select(F.col("parent").alias("at"), "child")
    front = edges.sparkSession.createDataFrame([(root, 0, root, [root])], "node string, depth int, path string, seen array<string>")
    out = front.select("node", "depth", "path")
    while True:
        down = front.join(keys, F.col("node") == F.col("at")).select(
            F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "child").alias("path"), F.array_contains("seen", F.col("child")).alias("again"), F.concat("seen", F.array("child")).alias("seen")
        )
        down = stored(down, "level")
        n = down.agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("again")).first()
        if n["again"]:
            raise ValueError("the edges make a cycle below the root")
        if not n["n"]:
            return out
        front = down.drop("again")
        out = out.unionByName(front.select("node", "depth", "path"))


def ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (column node) and all above them, whatever the depth. Each round joins only nodes that are new, so cycles end too."""
    up = edges.select(F.col("child").alias("at"), F.col("parent").alias("node"))
    out = front = stored(nodes.select("node").distinct(), "above")
    while True:
        more = front.withColumnRenamed("node", "at").join(up, "at").select("node").distinct().join(out, "node", "left_anti")
        front = stored(more, "above")
        if front.isEmpty():
            return out
        out = out.unionByName(front)


#: Levels of a tree from the root down; one without categories has no L2.
LEVELS = ("L0", "L1", "L2", "L3", "L4")


def assemble(domains: DataFrame, groups: DataFrame, leaves: DataFrame, categories: DataFrame | None = None, root: str = "root", text: str = "root") -> tuple[DataFrame, DataFrame]:
    """(nodes: node, level, description; edges: parent, child, pos) of a tree.

    domains: node, description. categories and groups: node, parent, description. leaves: node, parent, description.
    Without categories the groups hang under domains. Children stand in the order of their names, pos from 0; a child
    whose parent is not there raises, as its leaves could not be reached.
    """
    spark = domains.sparkSession
    layers = [("L1", domains.select("node", F.lit(root).alias("parent"), "description"))]
    layers += [] if categories is None else [("L2", categories.select("node", "parent", "description"))]
    layers += [("L3", groups.select("node", "parent", "description")), ("L4", leaves.select("node", "parent", "description"))]
    rows = None
    for level, df in layers:
        df = df.withColumn("level", F.lit(level))
        rows = df if rows is None else rows.unionByName(df)
    rows = stored(rows, "tree")
    known = rows.select(F.col("node").alias("parent")).unionByName(spark.createDataFrame([(root,)], "parent string"))
    lost = rows.join(known, "parent", "left_anti")
    if not lost.isEmpty():
        raise ValueError("a node's parent is not in the tree")
    from .ranks import numbered

    nodes = rows.select("node", "level", "description").unionByName(spark.createDataFrame([(root, LEVELS[0], text)], "node string, level string, description string"))
    edges = numbered(rows.select("parent", F.col("node").alias("child")), ["parent"], ["child"], "pos")
    return nodes, edges.select("parent", "child", "pos")


def depth(edges: DataFrame, root: str) -> int:
    """Nodes on the longest way down from the root, itself included."""
    return int(paths(edges, root).agg(F.max("depth")).first()[0]) + 1
