"""The refining modes with scripted replies, against one request at a time by hand; trees of any depth."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from canopy.operators import hierarchy, worklist
from canopy.operators.ranks import first_of, numbered

PARTS = "array<struct<text:string,expected:int>>"


def scripted(spark, scores, replies):
    """retrieve and refine from dicts: text to [(leaf, score)], text to [(text, expected)]."""
    lists = spark.createDataFrame([(t, i + 1, leaf, s) for t, ls in scores.items() for i, (leaf, s) in enumerate(ls)], "text string, rank int, leaf string, score double")
    parts = spark.createDataFrame([(t, ps) for t, ps in replies.items()], f"text string, parts {PARTS}")
    return lambda steps: steps.join(lists, "text"), lambda weak: weak.join(parts, "text")


def by_hand(steps, scores, replies, mode, k, budget, circles):
    """One request with a queue: traces in order, and the pool."""
    queue, traces, lists, used = deque((t, e, 0) for t, e in steps), [], [], 0
    while queue:
        t, e, c = queue.popleft()
        got = scores.get(t, [])
        lists.append((got, None))
        top = got[0][1] if got else None
        margin = got[0][1] - got[1][1] if len(got) > 1 else None
        if e != 1:
            why = "expected_multi_tool_step"
        elif top is None:
            why = "no_candidates"
        elif top < 0.35:
            why = "low_score"
        elif margin is not None and margin < 0.03:
            why = "low_margin"
        else:
            why = "accepted"
        if why in ("accepted", "no_candidates"):
            traces.append((t, c, "resolved" if why == "accepted" else "unresolved", why))
        elif c + 1 >= circles:
            traces.append((t, c, "unresolved", why + "_max_circles"))
        elif used >= budget:
            traces.append((t, c, "unresolved", why + "_max_refinements"))
        else:
            used += 1
            seen, kids = {t.strip().lower()}, []
            for x, n in replies.get(t, []):
                if x.strip() and x.strip().lower() not in seen:
                    seen.add(x.strip().lower())
                    kids.append((x.strip(), n))
            kids = kids[:8]
            if not kids or sum(n for _, n in kids) < e:
                traces.append((t, c, "unresolved", "refine_empty"))
            else:
                traces.append((t, c, "refine", why))
                queue.extend((x, n, c + 1) for x, n in kids)
        lists[-1] = (got, traces[-1][2])
    best, order = {}, []
    for got, d in lists:
        if mode == "refined_decompose":
            some = [(leaf, k - i) for i, (leaf, _) in enumerate(got)]
        else:
            some = got[:1] if d == "resolved" else []
        for leaf, s in some:
            if leaf not in best:
                order.append(leaf)
            best[leaf] = max(best.get(leaf, s), s)
    return sorted(traces), sorted(order, key=lambda x: -best[x])[:k]


FIXED = {
    "a and b": ([("x", 0.9), ("y", 0.5)], 2, [("do a", 1), ("do b", 1), (" DO A ", 1), ("a and b", 2), ("", 1)]),
    "do a": ([("x", 0.9), ("z", 0.1)], 1, []),
    "do b": ([("y", 0.6), ("x", 0.59)], 1, [("do b", 1)]),
    "lost": ([("x", 0.9), ("y", 0.1)], 3, [("do a", 1), ("do b", 1)]),
    "faint": ([("x", 0.2)], 1, [("nothing", 1)]),
    "nothing": ([], 1, []),
}


def run(spark, steps_of, scores, replies, mode, k=10, budget=20, circles=None):
    steps = spark.createDataFrame([(q, i, t, e) for q, steps in steps_of.items() for i, (t, e) in enumerate(steps)], "q long, pos int, text string, expected int")
    retrieve, refine = scripted(spark, scores, replies)
    got = worklist.work(steps, retrieve, refine, mode, k, circles, budget, many=lambda t: F.lit(False))
    traces, pool = {}, {}
    for r in got.traces.collect():
        traces.setdefault(r["q"], []).append((r["text"], r["circle"], r["decision"], r["reason"]))
    for r in got.pool.orderBy("q", "rank").collect():
        pool.setdefault(r["q"], []).append(r["leaf"])
    return {q: sorted(t) for q, t in traces.items()}, pool


@pytest.mark.parametrize("mode", ["refined_decompose", "recursive_decompose"])
def test_scripted_refinement(spark, mode):
    scores, replies = {t: v[0] for t, v in FIXED.items()}, {t: v[2] for t, v in FIXED.items()}
    steps = {1: [("a and b", 2), ("lost", 3)], 2: [("faint", 1)], 3: [("do a", 1)], 4: [("a and b", 2)] * 3}
    traces, pool = run(spark, steps, scores, replies, mode, budget=2)
    circles = worklist.CIRCLES[mode]
    for q, s in steps.items():
        want, order = by_hand(s, scores, replies, mode, 10, 2, circles)
        assert traces[q] == want and pool.get(q, []) == order, q
    reasons = {r[3] for t in traces.values() for r in t}
    assert {"expected_multi_tool_step", "refine_empty", "expected_multi_tool_step_max_refinements"} <= reasons
    assert ("low_margin_max_circles" in reasons) == (mode == "refined_decompose")


def test_random_refinement_against_one_request_at_a_time(spark):
    rng = random.Random(1)
    texts = [f"t{i}" for i in range(40)]
    scores = {t: [(f"l{rng.randrange(12)}{j}", round(s, 2)) for j, s in enumerate(sorted((rng.random() for _ in range(rng.randrange(4))), reverse=True))] for t in texts}
    replies = {t: [(rng.choice([*texts, "", t.upper()]), rng.randint(1, 2)) for _ in range(rng.randrange(5))] for t in texts}
    steps = {q: [(rng.choice(texts), rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(1, 5))] for q in range(25)}
    for mode, circles in (("refined_decompose", 2), ("recursive_decompose", 4)):
        traces, pool = run(spark, steps, scores, replies, mode, 6, 4, circles)
        for q, s in steps.items():
            want, order = by_hand(s, scores, replies, mode, 6, 4, circles)
            assert traces[q] == want, (mode, q)
            assert pool.get(q, []) == order, (mode, q)


def test_modes(spark):
    scores = {t: v[0] for t, v in FIXED.items()}
    retrieve, refine = scripted(spark, scores, {t: v[2] for t, v in FIXED.items()})
    asked = spark.createDataFrame([(1, "a and b"), (2, "do b"), (3, None)], "q long, text string")
    split = lambda r: spark.createDataFrame([(1, [("do a", 1), ("do b", 1)])], f"q long, parts {PARTS}")
    inject = lambda parts, q: F.concat(parts, F.array(F.lit("faint")))
    got = {m: [tuple(r) for r in worklist.answer(asked, m, retrieve, split, refine, inject).select("q", "rank", "leaf").orderBy("q", "rank").collect()] for m in ("direct", "decompose", "decompose_pattern_inject", "dependency_hinted_decompose", "refined_decompose", "recursive_decompose")}
    assert got["direct"] == [(1, 1, "x"), (1, 2, "y"), (2, 1, "y"), (2, 2, "x")]
    assert got["decompose"] == got["dependency_hinted_decompose"] == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 1, "y"), (2, 2, "x")]
    assert got["decompose_pattern_inject"][:2] == [(1, 1, "x"), (1, 2, "y")] and (3, 1, "x") in got["decompose_pattern_inject"]
    assert got["recursive_decompose"] == [(1, 1, "x")]
    with pytest.raises(ValueError):
        worklist.answer(asked, "other", retrieve, split)


def test_trees_of_any_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(11)], "parent string, child string")
    assert sorted((r["node"], r["depth"]) for r in hierarchy.paths(edges, "n0").collect()) == sorted((f"n{i}", i) for i in range(12))
    assert hierarchy.depth(edges, "n0") == 12
    assert hierarchy.ancestors(edges, spark.createDataFrame([("n11",)], "node string")).count() == 12
    loop = edges.unionByName(spark.createDataFrame([("n11", "n3")], "parent string, child string"))
    assert hierarchy.ancestors(loop, spark.createDataFrame([("n4",)], "node string")).count() == 12
    with pytest.raises(ValueError):
        hierarchy.paths(loop, "n0")


def test_assembly(spark):
    domains = spark.createDataFrame([("d1", "D")], "node string, description string")
    groups = spark.createDataFrame([("g1", "d1", "G"), ("g2", "d1", "H")], "node string, parent string, description string")
    leaves = spark.createDataFrame([(f"t{i}", f"g{1 + i % 2}", None) for i in range(5)], "node string, parent string, description string")
    nodes, edges = hierarchy.assemble(domains, groups, leaves)
    assert nodes.count() == 9 and hierarchy.depth(edges, "root") == 4
    assert sorted((r["child"], r["pos"]) for r in edges.filter("parent = 'g1'").collect()) == [("t0", 0), ("t2", 1), ("t4", 2)]
    with pytest.raises(ValueError):
        hierarchy.assemble(domains, groups.withColumn("parent", F.lit("none")), leaves)


def test_numbers_and_firsts_of_a_large_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 10 else f"c{i % 70}", rng.choice([None, *range(500)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    for order in (["a", "b"], ["s", "b"]):
        got = numbered(df.withColumn("s", F.lpad(F.col("a").cast("string"), 4, "0")), ["g"], order, "n", rows_per_range=200).collect()
        by = {}
        for r in got:
            by.setdefault(r["g"], []).append(r)
        for g in by.values():
            g.sort(key=lambda r: (r["a"] is not None, r["a"] or 0, r["b"]))
            assert [r["n"] for r in g] == list(range(len(g)))
    first = {r["g"]: r["items"] for r in first_of(df, ["g"], "b", "b", 3).collect()}
    assert first["hot"] == [1, 2, 3]
