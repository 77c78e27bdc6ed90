"""Logs of runs, evaluation, the benchmark, annealed clusters, enrichment replies and probed neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import text
from canopy.operators import cluster, runs, similarity


def test_state_fold(spark):
    rng = random.Random(1)
    rows, state, revision = [], {}, {}
    for seq in range(200):
        run = rng.randrange(4)
        put = {f"k{rng.randrange(6)}": str(seq) for _ in range(rng.randrange(3))}
        drop = [f"k{rng.randrange(6)}" for _ in range(rng.randrange(2))]
        rows.append((run, seq, put or None, drop or None))
        state.setdefault(run, {}).update(put)
        for k in drop:
            state[run].pop(k, None)
        revision[run] = revision.get(run, 0) + bool(put or drop)
    values, counts = runs.fold_state(spark.createDataFrame(rows, "run int, seq int, set map<string,string>, remove array<string>"))
    assert {(r["run"], r["key"], r["value"]) for r in values.collect()} == {(a, k, v) for a, s in state.items() for k, v in s.items()}
    assert {r["run"]: r["revision"] for r in counts.collect()} == revision


def test_step_fold(spark):
    log = [(1, 0, "a", "running", None, None), (1, 1, "a", "complete", "ok", [("x", "1"), ("y", "2")]), (1, 2, "b", "fail", "bad", None), (1, 3, "b", "running", None, None), (1, 4, "c", "complete", "fine", [("z", "3")])]
    states, made = runs.fold_steps(spark.createDataFrame(log, "run int, seq int, step string, what string, summary string, artifacts array<struct<name:string,payload:string>>"))
    assert sorted(tuple(r)[1:] for r in states.collect()) == [("a", "done", "ok"), ("b", "running", "bad"), ("c", "done", "fine")]
    assert sorted((r["artifact"], r["payload"]) for r in made.collect()) == [("a-artifact-1", "1"), ("a-artifact-2", "2"), ("c-artifact-3", "3")]


def test_evaluation(spark):
    steps = spark.createDataFrame([(1, "a", "reason", "done", None), (1, "b", "tool", "done", "w"), (2, "a", "tool", "failed", None), (2, "b", "tool", "pending", "w"), (3, "a", "tool", "done", "w"), (3, "b", "tool", "skipped", "w")], "run int, step string, kind string, status string, capability string")
    deps = spark.createDataFrame([(1, "b", "a"), (2, "a", "none"), (3, "a", "b"), (3, "b", "a")], "run int, step string, dep string")
    told = "run int, step string, key string, value string"
    expected = spark.createDataFrame([(1, "a", "k", "1"), (1, "b", "gone", "1"), (2, "a", "k", "1"), (2, "z", "k", "1")], told)
    observed = spark.createDataFrame([(1, "a", "k", "1"), (2, "a", "k", "2"), (2, "z", "k", "2")], told)
    plans = spark.createDataFrame([(1, 1, None), (2, 2, 0.5), (3, 1, None), (4, 1, None)], "run int, version int, efficiency double")
    got = {r["run"]: r for r in runs.evaluate(steps, deps, expected, observed, plans).collect()}
    assert got[1]["passed"] and got[1]["score"] == 1.0
    assert got[2]["faults"] == 3 and got[2]["score"] == pytest.approx(0.3 * 0 + 0.2 * 0.5 + 0.2 * 0 + 0.15 * 0.5 + 0.1 * 0.5 + 0.05 * 0.5)
    assert got[3]["faults"] == 1 and got[3]["score"] == pytest.approx(0.3 + 0.2 * 0.5 + 0.2 + 0.15 + 0.1 + 0.05)
    assert got[4]["passed"] and got[4]["score"] == pytest.approx(0.2 + 0.15 + 0.1 + 0.05)
    assert {r["run"]: r["status"] for r in runs.finalize(runs.evaluate(steps, deps, expected, observed, plans)).collect()} == {1: "completed", 2: "failed", 3: "failed", 4: "completed"}


def test_benchmark(spark):
    schema = "id string, query string, min_steps int, max_steps int, kinds array<string>, terms array<string>, constraints array<string>, notes array<string>, min_grounded int, floor double"
    rows = [
        ("a", "Search pages; then write text. It must be short", 3, 5, ["retrieve", "synthesize", "validate"], ["PAGES", "nowhere"], ["must be", "never"], ["query contains unresolved pronouns"], 4, None),
        ("b", "hello", 1, 2, None, [], [], [], None, 0.95),
    ]
    got = {r["id"]: r for r in runs.benchmark(spark.createDataFrame(rows, schema), [("web_search", "search pages"), ("text_generation", "write text"), ("validator", "validate check")]).collect()}
    a = got["a"]
    parts = {n: a[n] for n in runs.BENCHMARK}
    assert a["step_count"] == 4 and parts["kind_coverage"] == 1.0 and parts["term_coverage"] == 0.5 and parts["constraint_recall"] == 0.5 and parts["ambiguity_recall"] == 1.0
    assert 0 < parts["grounding_coverage"] <= 1 and a["score"] == pytest.approx(sum(w * parts[n] for n, w in runs.BENCHMARK.items()), abs=1e-6)
    assert a["passed"] == (a["score"] >= 0.7) and got["b"]["step_count"] == 3 and got["b"]["step_range"] == 0.0 and not got["b"]["passed"]


def test_annealed_clusters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) * 0.1 + np.repeat([[0, 0], [3, 0], [0, 3]], 20, 0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    cents = cluster.initial_centroids(rows, 3)
    labels, got = cluster.soft_cluster(rows, cents, rounds=6, most_alpha=8.0, balance=0.1, tol=1e-6)
    c, before = np.array([r["centroid"] for r in cents.orderBy("label").collect()]), np.inf
    soft = lambda a: (lambda e: e / e.sum(1, keepdims=True))(np.exp(-a * (((x[:, None] - c[None]) ** 2).sum(2) - ((x[:, None] - c[None]) ** 2).sum(2).min(1, keepdims=True))))
    for step in range(6):
        w = soft(8.0 * (step / 5) ** 2)
        p = w.sum(0) / w.sum()
        new = (w.T @ x) / w.sum(0)[:, None]
        goal = np.linalg.norm(new - c) + 0.1 * (p * p).sum()
        c = new
        if abs(before - goal) < 1e-6:
            break
        before = goal
    assert np.array([r["centroid"] for r in got.orderBy("k").collect()]) == pytest.approx(c, abs=1e-9)
    assert [r["k"] for r in labels.orderBy("id").collect()] == soft(8.0).argmax(1).tolist()


def test_any_number_of_centroids(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(5)], "id long, v array<double>")
    cents = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(2501)], "label long, centroid array<double>")
    few, many = (cluster.distances(rows, cents, most=m) for m in (10_000, 100))
    key = lambda d: sorted((r["id"], r["k"], r["d2"]) for r in d.collect())
    assert len(key(few)) == 5 * 2501 and key(few) == key(many)


def test_enrichment_replies(spark):
    good = '```json\n{"intent_phrase": "sort it", "input_kind": "list", "synonyms": ["order"], "example_queries": ["a", "b"], "more": 1}\n```'
    df = spark.createDataFrame([(1, good), (2, "no json"), (3, "{}"), (4, None)], "i int, raw string")
    got = {r["i"]: r["e"].asDict() for r in df.select("i", text.parse_enrichment(F.col("raw"), F.lit("tool")).alias("e")).collect()}
    assert got[1] == {"intent_phrase": "sort it", "input_kind": "list", "output_kind": "", "synonyms": ["order"], "example_queries": ["a", "b"]}
    assert got[2] == got[4] == {"intent_phrase": "tool", "input_kind": "input", "output_kind": "output", "synonyms": [], "example_queries": ["tool"]}
    assert got[3] == {"intent_phrase": "", "input_kind": "", "output_kind": "", "synonyms": [], "example_queries": []}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_probed_neighbours_recall(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), cluster.unit(F.col("embedding").cast("array<double>")).alias("v"))
    want, got = {}, {}
    for out, df in ((want, similarity.knn_graph(v, 5)), (got, similarity.probed_neighbours(v, 5))):
        for r in df.collect():
            out.setdefault(r["i"], set()).add(r["j"])
    assert all(len(got[i]) == 5 for i in want)
    assert sum(len(want[i] & got[i]) for i in want) / (5 * len(want)) >= 0.9
