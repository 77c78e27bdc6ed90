"""What showed only on larger or odd tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.plans import ORACLES, QUERIES


def folder(spark, at, rows):
    """A folder whose table embeddings holds rows (vec_id, embedding, label), and DuckDB's view of it."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{at}/embeddings.parquet/*.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["residuals", "centroids"])
def test_zero_keeps_its_sign_and_null_labels_meet_nothing(spark, tmp_path, name):
    at, con = folder(spark, tmp_path, [(0, [-1e-7, 0.5], 0), (1, [-3e-7, 0.25], 0), (2, [0.5, 0.5], None)])
    value = {"residuals": "residual", "centroids": "centroid"}[name]
    want = con.execute(f"SELECT {value} FROM ({ORACLES[name]})").fetchall()
    got = QUERIES[name](spark, at).select(value).collect()
    assert sorted(repr(list(r[0])) for r in got) == sorted(repr(list(r[0])) for r in want)
    assert any("-0.0" in repr(r[0]) for r in want)


def test_leaves_by_blocks_are_those_by_a_join(spark, monkeypatch):
    from canopy.functions.vec import norm
    from canopy.operators import retrieve

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)).round(1)
    v[40:70] = v[3]  # equal vectors tie
    v[71] = 0
    rows = [(i % 3, i, i, [float(x) for x in v[i]]) for i in range(300)] + [(0, 900, 900, [1.0, 2.0]), (1, 901, 901, None), (2, 902, 902, [1.0, None, 0.0, 0.0, 0.0, 1.0])]
    leaves = spark.createDataFrame(rows, "parent long, pos long, leaf long, v array<double>").withColumn("n", norm(F.col("v")))
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in v[i]]) for i in range(0, 300, 4)] + [("none", None)], "q string, qv array<double>")
    ends = asked.selectExpr("q", "explode(array(0L, 1L, 2L)) as parent").withColumn("parent_rank", F.col("parent").cast("int"))
    found = lambda few: sorted((r["q"], r["rank"], r["leaf"], r["score"] and round(r["score"], 12)) for r in retrieve.ranked_leaves(ends, asked, leaves, 10, few).collect())
    want = found(10**9)
    monkeypatch.setattr(retrieve, "BLOCK", 64)
    assert found(0) == want and len(want) == 760


def test_no_leaf_is_scored_for_a_path(spark, tmp_path, monkeypatch):
    from canopy.operators import retrieve

    monkeypatch.setattr(retrieve, "ranked_leaves", lambda *_: pytest.fail("leaves were ranked"))
    assert QUERIES["beam_path"](spark, "/root/testdata/sf0.001").count() > 0


def test_leaves_of_large_parents_are_not_joined(spark, monkeypatch):
    """The pairs of queries and leaves grow with the square of the table, so they may not be rows of a plan."""
    from canopy.operators import retrieve

    seen, keep = [], retrieve.stored
    monkeypatch.setattr(retrieve, "stored", lambda df, name: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "found" else None) or keep(df, name))
    v = [(i % 2, i, i, [float(i % 7), 1.0]) for i in range(200)]
    leaves = spark.createDataFrame(v, "parent long, pos long, leaf long, v array<double>").withColumn("n", F.lit(1.0))
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "q long, qv array<double>")
    ends = asked.select("q", F.lit(0).cast("long").alias("parent"), F.lit(1).alias("parent_rank"))
    assert retrieve.ranked_leaves(ends, asked, leaves, 5).count() == 100
    assert "FlatMapGroupsInArrow" in seen[0]


@pytest.mark.parametrize("name", ["gold_resolution", "resolved_pool"])
def test_routes_are_worked_out_once(spark, monkeypatch, name):
    from canopy.operators import retrieve

    seen, keep = [], retrieve.descend
    monkeypatch.setattr(retrieve, "descend", lambda *a: seen.append(1) or keep(*a))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").columns and len(seen) == 1


def test_no_pair_of_a_greedy_scan_is_stored(spark, monkeypatch):
    """A scan in several turns gives the rows of one scan, and stores no more rows than there are."""
    from canopy.operators import dedupe

    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 4))
    u, want = x / np.linalg.norm(x, axis=1)[:, None], []
    for i in range(900):
        if all(u[i] @ u[j] < 0.9 for j in want):
            want.append(i)
    most, keep = [], dedupe.stored
    monkeypatch.setattr(dedupe, "stored", lambda df, name: (out := keep(df, name), most.append(out.count()))[0])
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, v array<double>")
    assert sorted(r["id"] for r in dedupe.near_dedupe(df, 0.9, **({"chunk": 100} if "chunk" in dedupe.near_dedupe.__code__.co_varnames else {})).collect()) == want
    assert max(most) <= 900 and len(most) > 2


@pytest.mark.parametrize("symmetric", [True, False])
def test_rows_are_shuffled_a_few_times_only(spark, symmetric):
    """50,000 rows make 8 blocks; those of 4,096 rows made 13, and of doubles. A row stands in as many groups as there are blocks."""
    from canopy.operators.similarity import _by_blocks

    v = spark.range(50_000).select("id", F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("v"))
    dealt = _by_blocks(v, symmetric)
    dealt = dealt if not isinstance(dealt, tuple) else dealt[0]
    assert dict(dealt.dtypes)["v"] == "array<float>"
    assert dealt.count() == 50_000 * (9 if symmetric else 16)


def test_copies_of_a_vector_tie_by_id(spark):
    from canopy.operators.similarity import knn_graph

    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(i), 1.0, -2.0]) for i in range(60)]
    got = knn_graph(spark.createDataFrame(rows, "id long, v array<double>"), 4).filter("i = 59").orderBy("rank").collect()
    assert [r["j"] for r in got] == [1, 3, 5, 7]


def test_constraints_are_looked_for_once(spark):
    plan = QUERIES["extract_constraints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 5


def test_words_of_sources_are_hashed_and_not_sorted(spark):
    plan = QUERIES["cluster_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_probing_deals_rows_by_blocks_and_not_by_lists(spark, monkeypatch):
    from canopy.operators import cluster, similarity

    dealt, keep = [], similarity._by_blocks
    monkeypatch.setattr(similarity, "_by_blocks", lambda *a: dealt.append(1) or keep(*a))
    rows = spark.range(40).select("id", cluster.unit(F.array(F.col("id") * 1.0, F.lit(3.0))).alias("v"))
    assert similarity.probed_neighbours(rows, 3).count() == 120 and dealt
