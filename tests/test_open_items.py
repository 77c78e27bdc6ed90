"""Search, providers, prompts, settings and the choices between backends."""

import heapq
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from canopy.operators import cluster, planner, similarity
from canopy.operators.search import best_first
from canopy.plans import prompts
from canopy.sources import config, providers, store

EDGE = "parent string, child string, score double, pos int, terminal boolean"
ROOT = "search string, node string, score double, terminal boolean"


def by_hand(root, graph, limit, width):
    """One search with a heap: (best, path, visited, expansions)."""
    heap, turn, visited, done = [(-root[1], 0, root[0], root[2], [root[0]])], 1, [], 0
    best = (root[1], root[0], [root[0]])
    while heap and done < limit:
        s, _, node, terminal, path = heapq.heappop(heap)
        visited.append(node)
        if -s > best[0] or terminal:
            best = (-s, node, path)
        if terminal:
            break
        for child, score, end in sorted(graph.get(node, []), key=lambda c: -c[1])[:width]:
            heapq.heappush(heap, (-score, turn, child, end, [*path, child]))
            turn += 1
        done += 1
    return best[1], best[2], visited, done


def test_search_finds_the_better_branch(spark):
    edges = spark.createDataFrame([("root", "a", 0.4, 0, False), ("root", "b", 0.8, 1, False), ("a", "a1", 0.5, 0, False), ("b", "b1", 0.9, 0, True)], EDGE)
    r = best_first(spark.createDataFrame([("s", "root", 0.1, False)], ROOT), edges, 4, 2).first()
    assert (r["best"], r["path"], r["visited"], r["expansions"]) == ("b1", ["root", "b", "b1"], ["root", "b", "b1"], 2)


def test_search_against_a_heap(spark):
    rng = random.Random(3)
    graph = {f"n{i}": [(f"n{rng.randrange(12)}", rng.randrange(6) / 5, rng.random() < 0.05) for _ in range(rng.randrange(5))] for i in range(12)}
    rows = [(p, c, s, i, e) for p, kids in graph.items() for i, (c, s, e) in enumerate(kids)]
    roots = [(f"s{i}", f"n{i}", 0.2, False) for i in range(6)] + [("none", None, None, None), ("leaf", "zz", 0.5, None)]
    got = {r["search"]: (r["best"], r["path"], r["visited"], r["expansions"]) for r in best_first(spark.createDataFrame(roots, ROOT), spark.createDataFrame(rows, EDGE), 7, 3).collect()}
    assert len(got) == len(roots)
    for s, node, score, end in roots:
        if node is not None:
            assert got[s] == by_hand((node, score, bool(end)), graph, 7, 3), s
    assert best_first(spark.createDataFrame([], ROOT), spark.createDataFrame([], EDGE)).count() == 0


def fake():
    """A client class that pickles by value, as workers cannot import this module."""

    class Fake:
        def __init__(self):
            self.tried = set()

        def reply(self, prompt):
            if prompt == "flaky" and prompt not in self.tried:
                self.tried.add(prompt)
                raise OSError("once")
            if prompt == "dead":
                raise OSError("always")
            return prompt.upper()

        def embed(self, texts):
            return [[len(t), 1] for t in texts]

    return Fake


def test_replies_and_vectors(spark):
    asked = spark.createDataFrame([("a", "hi"), ("b", None), ("c", "flaky")], "key string, prompt string")
    assert dict(providers.replies(asked, fake(), pause=0.01).select("key", "value").collect()) == {"a": "HI", "b": None, "c": "FLAKY"}
    with pytest.raises(Exception, match="no reply after 3 attempts"):
        providers.replies(spark.createDataFrame([("x", "dead")], "key string, prompt string"), fake(), pause=0.01).collect()
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, t string").coalesce(1)
    assert {r["id"]: r["embedding"] for r in providers.embedded(rows, fake(), "t", batch=1).collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    assert providers.embedded(rows.limit(0), fake(), "t").count() == 0


def test_replies_fill_the_cache(spark):
    asked = spark.createDataFrame([("a", "hi"), ("a", "hi"), ("b", "yo")], "key string, prompt string")
    cache = spark.createDataFrame([("b", "kept")], "key string, value string")
    full, new = store.cached(asked, cache, lambda misses: providers.replies(misses, fake()))
    assert sorted(r["value"] for r in full.collect()) == ["HI", "HI", "kept"] and [tuple(r) for r in new.collect()] == [("a", "HI")]


def test_endpoint():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path.endswith("embeddings"):
                out = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                out = {"choices": [{"message": {"content": body["model"] + ":" + body["messages"][0]["content"]}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = providers.Endpoint(f"http://127.0.0.1:{server.server_port}/v1/", "m")
    assert e.reply("hi") == "m:hi" and e.embed(["a", "bcd"]) == [[1.0], [3.0]]
    server.shutdown()


def test_prompts(spark):
    row = spark.createDataFrame([("sort <it>", ["text tools", "time"], [("n", 0.51239, "a\nb " + "x" * 200), ("m", 0.2, None)], " \n L1 \nL2", " ")], "q string, areas array<string>, c array<struct<name:string,score:double,doc:string>>, r string, none string")
    got = row.select(
        prompts.decompose(F.col("q"), F.col("areas")).alias("d"), prompts.decompose(F.col("q"), F.array().cast("array<string>")).alias("e"), prompts.refine(F.col("q"), F.lit(2), F.lit("low_score"), F.col("c"), F.col("areas")).alias("r"),
        prompts.candidates(F.array().cast("array<struct<name:string,score:double,doc:string>>")).alias("n"), prompts.with_dependencies(F.col("q"), F.col("areas")).alias("h"), prompts.plan(F.col("q"), F.col("areas")).alias("p"),
        providers.label_of(F.col("r")).alias("l"), providers.label_of(F.col("none")).alias("u"), prompts.describe(F.lit("- a\n- b"), F.lit("- c")).alias("x"), prompts.enrich(F.lit("N"), F.lit(None).cast("string"), F.lit("D")).alias("y"),
    ).first()
    assert "- text tools\n- time\n" in got["d"] and got["d"].endswith("User query: sort <it>\nJSON:") and "(no schema provided)" in got["e"]
    assert "- n (0.512) - a b " + "x" * 115 + "...\n- m (0.200)\n" in got["r"] and got["n"] == "(no candidates)" and "Tools expected: 2\n" in got["r"]
    assert "UUID" in got["h"] and "expected_tools" in got["p"] and (got["l"], got["u"]) == ("L1 ", "Unlabeled cluster") and "NAME: N\nSIGNATURE: \nDOC: D" in got["y"]
    back = spark.createDataFrame([(got["x"], got["y"])], "x string, y string").select(prompts.block(F.col("x"), "MEMBERS:\n").alias("m"), prompts.block(F.col("x"), "NEIGHBORS:\n").alias("n"), prompts.block(F.col("x"), "OTHER:\n").alias("o"), prompts.capture(F.col("y"), r"NAME: (.*)").alias("c"), prompts.capture(F.col("y"), r"ELSE: (.*)").alias("z")).first()
    assert tuple(back) == ("- a\n- b\n", "- c\n", "", "N", None)
    assert [prompts.mode(set(f)) for f in ([], ["pattern_inject"], ["decompose"], ["decompose", "pattern_inject"], ["refined_decompose", "decompose", "recursive_decompose"], ["dependency_hinted_decompose", "refined_decompose"])] == ["direct", "direct", "decompose", "decompose_pattern_inject", "refined_decompose", "dependency_hinted_decompose"]


def test_settings(spark, tmp_path):
    given = {"thresholds": {"group": "0.5"}, "fanout": {"group": [1, 2]}, "embedding_dim": "8", "other": 1, "labeler_llm_per_level": {"group": "x"}}
    (tmp_path / "c.json").write_text(json.dumps(given))
    c = config.load(spark, str(tmp_path / "c.json"))
    assert c.thresholds == {"near_dup": 0.97, "group": 0.5, "category": 0.45, "domain": 0.7} and c.fanout == {"group": (1, 2)} and c.embedding_dim == 8
    assert (c.labeler("group"), c.labeler("domain"), c.labeler(None)) == ("x", "fake", "fake") and config.from_dict({}) == config.Settings()
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(given))
    assert config.load(spark, str(tmp_path / "c.yaml")) == c


def test_choices(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i == j) + 0.01 * i for j in range(4)]) for i in range(4)], "id long, v array<double>").select("id", cluster.unit(F.col("v")).alias("v"))
    assert similarity.neighbours(rows, 2).count() == 8 and similarity.neighbours(rows, 2, "probed").count() == 8
    with pytest.raises(ValueError):
        similarity.neighbours(rows, 2, "other")
    c = cluster.initial_centroids(rows, 6)
    assert [r["label"] for r in c.orderBy("label").collect()] == list(range(6)) and all(len(r["centroid"]) == 4 for r in c.collect())
    assert {tuple(r["v"]) for r in rows.collect()} == {tuple(r["centroid"]) for r in c.filter("label < 4").collect()}
    assert cluster.initial_centroids(rows.limit(0), 3).count() == 0


def test_runs_and_cases(spark, tmp_path):
    plans, steps = planner.start_runs(spark.createDataFrame([(1, "search pages; write text")], "k long, q string"), "k", "q", [("web_search", "search pages")])
    p, s = plans.first(), steps.collect()
    assert p["run"].startswith("run-") and len(p["run"]) == 16 and p["version"] == 1 and {r["run"] for r in s} == {p["run"]}
    assert [(r["step"], r["status"]) for r in s] == [("step_1", "pending"), ("step_2", "pending"), ("validate_response", "pending")] and s[0]["capability"] == "web_search"
    (tmp_path / "cases.jsonl").write_text('{"id": "a", "query": "q", "calls": ["x"]}\n\n{"id": "b", "other": 1}\n')
    assert sorted((r["id"], r["query"]) for r in store.read_cases(spark, str(tmp_path / "cases.jsonl")).collect()) == [("a", "q"), ("b", None)]
