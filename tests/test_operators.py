"""Operators on small fixtures with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import rules, text
from canopy.operators import cluster, hierarchy, incremental, planner, retrieve
from canopy.operators.dedupe import exact_dedupe, near_dedupe
from canopy.operators.similarity import knn_graph, similar_pairs
from canopy.sources import store
from canopy.streaming import feedback


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<string>"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())).select(column.alias("x")).first()["x"]


# ---- text


@pytest.mark.parametrize("name,doc,want", [("user_delete", "", "write"), ("dataset", "", "write"), ("money", "transfer funds", "transact"), ("x", "search it", "read"), ("x", "", "compute"), ("x", "post a letter", "write")])
def test_side_effects(spark, name, doc, want):
    assert one(spark, text.side_effect(F.col("n"), F.col("d")), n=name, d=doc) == want


def test_words(spark):
    assert one(spark, text.keywords(F.col("t")), t="The Users and users of read_Table ab x1y") == ["users", "read_table", "x1y"]
    assert one(spark, text.verb_of(F.col("t")), t="db_users_read") == "read"
    assert one(spark, text.verb_of(F.col("t")), t="getUser") == "get"
    assert one(spark, text.verb_of(F.col("t")), t="user") == "perform"
    assert one(spark, text.sibling(F.lit("get")), t="") == "read" and one(spark, text.sibling(F.lit("scan")), t="") == "scan"
    assert one(spark, text.summary(F.col("t"), 10), t="abc\ndef ghi jkl") == "abc def g..."
    assert one(spark, text.member_block(F.array()), t="") == "(none)"


@pytest.mark.parametrize("raw,want", [('["a", " b ", "", 3, {"x": 1}, true]', ["a", "b", "3", "true"]), ('```json\n["a"]\n```', ["a"]), ("nothing", ["q"]), ('{"a": 1}', ["q"]), ("[]", ["q"]), (str([str(i) for i in range(12)]).replace("'", '"'), [str(i) for i in range(8)])])
def test_parse_strings(spark, raw, want):
    assert one(spark, text.parse_strings(F.col("r"), F.lit("q")), r=raw) == want


def test_parse_steps(spark):
    got = one(spark, text.parse_steps(F.col("r"), F.lit("q")), r='[{"text": "a", "expected_tools": 0}, {"text": "b", "expected_tools": 12}, "c", {"x": 1}]')
    assert [tuple(s) for s in got] == [("a", 1), ("b", 8), ("c", 1)]
    assert [tuple(s) for s in one(spark, text.parse_steps(F.col("r"), F.lit("q")), r="!")] == [("q", 1)]


def test_requests(spark):
    assert one(spark, text.split_steps(F.col("t")), t="Find a. Then check it, and then write; ok then. go") == ["Find a", "Then check it", "write", "ok", "go"]
    assert one(spark, text.constraints(F.col("t")), t="You must go. you MUST go; without noise by night") == ["must go", "without noise by night", "by night"]
    assert one(spark, text.ambiguities(F.col("t")), t="do it or not") == ["query contains unresolved pronouns", "query may contain branching choices"]
    assert one(spark, text.many_intents(F.col("t")), t="fetch it and hash it") is True
    assert one(spark, text.many_intents(F.col("t")), t="fetch it and fetch it") is False
    assert one(spark, text.title(F.col("t"), F.lit("3")), t="find all the big red things") == "Find all the big red"


@pytest.mark.parametrize("q,names", [("fetch https://x.io and read the JSON", {"url_parse", "http_get", "json_query"}), ("what day is it today", {"day_of_week", "get_current_datetime"}), ("nothing here", set()), ("convert 5 km", {"unit_converter"}), ("convert this", set())])
def test_rules(spark, q, names):
    assert {r["name"] for r in one(spark, rules.fired(F.col("q")), q=q)} == names


def test_injection_keeps_originals(spark):
    parts = F.array(F.lit("a"), F.lit("a"), F.lit(" SORT an array"))
    assert one(spark, rules.inject(parts, F.col("q")), q="sort by name and hash") == ["a", "a", " SORT an array", "compute a SHA-256 hash of text"]


# ---- vectors


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def test_pairs_and_knn(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[3] = 0
    df = vecs(spark, x.tolist())
    n = np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))
    c = (x / n[:, None]) @ (x / n[:, None]).T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if c[i, j] >= 0.3}
    assert {(r["a"], r["b"]) for r in similar_pairs(df, 0.3).collect()} == want
    got = knn_graph(df, 4).orderBy("i", "rank").collect()
    assert len(got) == 240 and all(r["i"] != r["j"] for r in got)
    assert [r["j"] for r in got if r["i"] == 0] == np.argsort(-np.where(np.arange(60) == 0, -9, c[0]), kind="stable")[:4].tolist()


def test_greedy_near_dedupe(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    kept = []
    for i in range(80):
        if all(u[i] @ u[j] < 0.7 for j in kept):
            kept.append(i)
    assert sorted(r["id"] for r in near_dedupe(vecs(spark, x.tolist()), 0.7).collect()) == kept


def test_clusters(spark):
    df = vecs(spark, [[1, 0, 0, 0], [0.99, 0.1, 0, 0], [0, 0, 1, 0], [0, 0, 0.98, 0.1], [0.98, 0.12, 0, 0]])
    got = {r["id"]: r["cluster"] for r in cluster.components(df.select("id"), similar_pairs(df, 0.8)).collect()}
    assert got == {0: 0, 1: 0, 4: 0, 2: 2, 3: 2}
    capped = [r["cluster"] for r in cluster.capped_clusters(df, 0.8, 2).collect()]
    assert max(capped.count(c) for c in capped) == 2
    line = spark.createDataFrame([(i,) for i in range(40)], "id long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(39) if i != 19], "a long, b long")
    assert {r["cluster"] for r in cluster.components(line, chain).collect()} == {0, 20}


def test_kmeans_and_soft(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    df = vecs(spark, x.tolist())
    start = spark.createDataFrame([(0, [1.0, 1.0]), (1, [4.0, 4.0]), (2, [8.0, 8.0]), (3, [99.0, 99.0])], "label long, centroid array<double>")
    assigned, new = cluster.kmeans_step(df, start)
    assert {r["k"]: r["n"] for r in new.collect()} == {0: 30, 1: 30, 2: 30, 3: 0}
    before = assigned.agg(F.sum("d2")).first()[0]
    after, _ = cluster.em_refine(df, start, 2)
    assert after.agg(F.sum("d2")).first()[0] < before
    soft = cluster.soft_assign(df, start, 0.5)
    assert all(abs(r["s"] - 1) < 1e-9 for r in soft.groupBy("id").agg(F.sum("weight").alias("s")).collect())


def test_merge_small_stops_at_the_first_without_room():
    assert cluster.merge_small([(0, 1, [0.0]), (1, 5, [1.0]), (2, 9, [9.0])], 3, 10) == {0: 1, 1: 1, 2: 2}
    assert cluster.merge_small([(0, 2, [0.0]), (1, 1, [1.0])], 3, 2) == {0: 0, 1: 1}


# ---- retrieval


def small_tree(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "node long, v array<double>").withColumn("n", F.lit(1.0))
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 3, 0)], "parent long, child long, pos long")
    leaves = spark.createDataFrame([(3, 0, 30, [0.0, 1.0]), (2, 0, 20, [0.6, 0.8]), (2, 1, 21, [0.0, 1.0])], "parent long, pos long, leaf long, v array<double>").withColumn("n", F.lit(1.0))
    return nodes, edges, leaves


def test_child_rescues_parent_and_beam(spark):
    nodes, edges, leaves = small_tree(spark)
    q = spark.createDataFrame([(7, [0.0, 1.0])], "q long, qv array<double>")
    found, path = retrieve.beam(q, nodes, edges, leaves, 0, 1, 5)
    assert [r["leaf"] for r in found.orderBy("rank").collect()] == [30]
    assert [(r["level"], r["node"]) for r in path.orderBy("level").collect()] == [(0, 1), (1, 3)]


def test_maxsim_puts_unknown_at_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, qv array<double>")
    c = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7)], "q long, pos long, leaf long")
    v = spark.createDataFrame([(5, [-1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 1.0])], "leaf long, v array<double>")
    got = [(r["leaf"], round(r["score"], 3)) for r in retrieve.maxsim(c, v, q, 3).orderBy("rank").collect()]
    assert got == [(7, round(1 / math.sqrt(2), 3)), (6, 0.0), (5, -1.0)]


def test_union_pool_breaks_ties_by_first_seen(spark):
    r = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 1, 11), (1, 1, 0, 12), (1, 1, 1, 10)], "q long, sub int, rank int, leaf long")
    assert [x["leaf"] for x in retrieve.union_pool(r, 3, 5).orderBy("rank").collect()] == [10, 12, 11]


@pytest.mark.parametrize("args,want", [((2, 0.9, 0.9, False), ("refine", "expected_multi_tool_step")), ((1, None, None, False), ("unresolved", "no_candidates")), ((1, 0.2, 0.9, False), ("refine", "low_score")), ((1, 0.9, 0.01, False), ("refine", "low_margin")), ((1, 0.9, None, True), ("refine", "multi_intent_text")), ((1, 0.9, 0.5, False), ("resolved", "accepted"))])
def test_decision(spark, args, want):
    e, t, m, many = args
    d = retrieve.decision(F.lit(e), F.lit(t).cast("double"), F.lit(m).cast("double"), F.lit(many))
    assert tuple(one(spark, d, x="")) == want


# ---- hierarchy, incremental, planner


def test_hierarchy(spark):
    e = spark.createDataFrame([("root", "a"), ("a", "b"), ("b", "c"), ("root", "d")], "parent string, child string")
    assert {(r["node"], r["path"]) for r in hierarchy.paths(e, "root").collect()} == {("root", "root"), ("a", "root/a"), ("b", "root/a/b"), ("c", "root/a/b/c"), ("d", "root/d")}
    assert {r["node"] for r in hierarchy.ancestors(e, spark.createDataFrame([("b",)], "node string")).collect()} == {"b", "a", "root"}


def test_diff_and_decision(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, hash string")
    d = incremental.diff(prev, new)
    assert {r["name"]: r["status"] for r in d.collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert incremental.decide(d).first()["full_rebuild"] is True
    assert incremental.decide(d.limit(0)).first()["full_rebuild"] is True
    assert incremental.decide(d.filter("status = 'unchanged'")).first()["full_rebuild"] is False


def test_plans(spark):
    r = spark.createDataFrame([(1, "Find x; then write y"), (2, "hello")], "k long, q string")
    got = {(x["k"], x["step_id"], x["dep"], x["kind"]) for x in planner.build_plan(r, "k", "q").collect()}
    assert (1, "step_1", None, "retrieve") in got and (1, "validate_response", "step_2", "validate") in got and (2, "execute_request", "analyze_request", "tool") in got
    steps = spark.createDataFrame([(1, "a", "done"), (1, "b", "pending"), (1, "c", "pending"), (1, "d", "skipped"), (1, "e", "pending"), (1, "f", "pending")], "run long, step string, status string")
    deps = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "e", "d"), (1, "f", "zz")], "run long, step string, dep string")
    assert [x["step"] for x in planner.ready(steps, deps).collect()] == ["b"]
    new = spark.createDataFrame([(1, "a"), (1, "d"), (1, "b"), (1, "n")], "run long, step string")
    assert {x["step"]: x["status"] for x in planner.replan(steps, new).collect()} == {"a": "done", "d": "skipped", "b": "pending", "n": "pending"}
    loops = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "a", "b"), (2, "b", "c"), (3, "x", "x")], "run long, step string, dep string")
    assert sorted(x["run"] for x in planner.cyclic(loops).collect()) == [1, 3]


def test_grounding_takes_the_first_of_equals(spark):
    s = spark.createDataFrame([("find pages", None), ("find pages", "b"), ("zzz", None)], "text string, hint string")
    got = [r["capability"] for r in planner.ground(s, [("a", "find pages"), ("b", "find pages")]).collect()]
    assert got == ["a", "b", None]


def test_quality_of_a_plan(spark):
    row = dict(steps=4, done=2, failed=1, issues=1, matched=1, checked=2, grounded=3, executable=3, version=2, efficiency=0.5)
    score = planner.quality(spark.createDataFrame([row])).first()["score"]
    assert score == pytest.approx(0.3 * 0.5 + 0.2 * 0.75 + 0.2 * 0.5 + 0.15 + 0.1 * 0.75 + 0.05 * 0.5)


# ---- stores and streams


def test_snapshots_and_catalogs(spark, tmp_path):
    root = str(tmp_path / "s")
    assert store.next_version(spark, root) == "v0"
    path = store.write_snapshot({"nodes": spark.range(3)}, root)
    assert path.endswith("v0") and store.next_version(spark, root) == "v1" and store.read_snapshot(spark, path, "nodes").count() == 3
    (tmp_path / "a.jsonl").write_text('{"name": "a", "doc": "d", "zzz": 1}\n\n{"name": "b"}\n')
    (tmp_path / "b.json").write_text('{"tools": [{"name": "a"}, {"name": "b"}, {"name": "c"}]}')
    (tmp_path / "c.json").write_text('[{"name": "a"}, {"name": "b"}]')
    assert [store.read_catalog(spark, str(tmp_path / f)).filter("name is not null").count() for f in ("a.jsonl", "b.json", "c.json")] == [2, 3, 2]
    with pytest.raises(ValueError):
        store.read_catalog(spark, "x.csv")
    with pytest.raises(ValueError):
        store.shard(F.lit("abc"), 5)


def test_cache_calls_misses_once(spark):
    asked = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2")], "key string, prompt string")
    known = spark.createDataFrame([("k1", "old")], "key string, value string")
    got, new = store.cached(asked, known, lambda m: m.select("key", F.concat(F.lit("new "), "prompt").alias("value")))
    assert sorted(r["value"] for r in got.collect()) == ["new p2", "new p2", "old"] and new.count() == 1


def test_fold_over_batches_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    kind = "run long, key string, value double, seq long"
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice("ab"), float(i), i) for i in range(60)]
    rng.shuffle(rows)
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], kind).coalesce(1).write.mode("append").parquet(src)
    log = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    feedback.run_once(feedback.fold(log), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = {(r["run"], r["key"]): (r["value"], r["revision"]) for r in feedback.read_latest(spark, str(tmp_path / "out"), ["run", "key"], ["value", "revision"]).collect()}
    want = {}
    for run, key, value, seq in rows:
        n, best = want.get((run, key), (0, (-1, 0)))
        want[run, key] = (n + 1, max(best, (seq, value)))
    assert got == {k: (b[1], n) for k, (n, b) in want.items()}


def test_exact_dedupe(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "id long, t string")
    assert sorted(r["id"] for r in exact_dedupe(df, ["t"], "id").collect()) == [1, 3]
