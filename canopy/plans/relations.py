"""Queries over hierarchies, plans and feedback, and relational ones beyond the retrieval engine (ext_)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import hierarchy, planner, runs, search
from ..sources.store import shared_dir, stored
from ..streaming import feedback
from .registry import Tables, query

EDGES = """e AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
PATHS = "RECURSIVE " + EDGES + ", p AS (SELECT 'root' AS node, 0 AS depth, 'root' AS path UNION ALL SELECT e.child, p.depth + 1, p.path || '/' || e.child FROM p JOIN e ON e.parent = p.node)"


def edges(t: Tables):
    def pair(table: str, a: str, parent, child_prefix: str, child: str):
        return t(table).select(parent.alias("parent"), F.concat(F.lit(child_prefix), F.col(child)).alias("child"))

    return (
        pair("region", "", F.lit("root"), "r", "r_regionkey")
        .unionByName(pair("nation", "", F.concat(F.lit("r"), "n_regionkey"), "n", "n_nationkey"))
        .unionByName(pair("customer", "", F.concat(F.lit("n"), "c_nationkey"), "c", "c_custkey"))
        .unionByName(pair("orders", "", F.concat(F.lit("c"), "o_custkey"), "o", "o_orderkey"))
    )


@query("hierarchy_edges", f"WITH {EDGES} SELECT parent, child FROM e")
def hierarchy_edges(t: Tables):
    return edges(t)


@query("hierarchy_depth", f"WITH {PATHS} SELECT max(depth) + 1 AS depth FROM p")
def hierarchy_depth(t: Tables):
    return hierarchy.paths(edges(t), "root").agg((F.max("depth") + 1).alias("depth"))


@query("hierarchy_paths", f"WITH {PATHS} SELECT node, depth, path FROM p")
def hierarchy_paths(t: Tables):
    return hierarchy.paths(edges(t), "root")


@query("reachable_leaves", f"WITH {PATHS} SELECT node FROM p WHERE node NOT IN (SELECT parent FROM e)")
def reachable_leaves(t: Tables):
    e = edges(t)
    return hierarchy.paths(e, "root").select("node").join(e.select(F.col("parent").alias("node")), "node", "left_anti")


@query("non_leaf_nodes", f"WITH {EDGES} SELECT DISTINCT parent AS node FROM e WHERE child IN (SELECT parent FROM e)")
def non_leaf_nodes(t: Tables):
    e = edges(t)
    return e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select(F.col("parent").alias("node")).distinct()


@query("tree_node_counts", f"WITH {EDGES} SELECT parent AS node, count(*) FILTER (WHERE inner_) AS inner_children, count(*) FILTER (WHERE NOT inner_) AS leaf_children FROM (SELECT parent, child IN (SELECT parent FROM e) AS inner_ FROM e) GROUP BY parent")
def tree_node_counts(t: Tables):
    e = edges(t)
    inner = e.select(F.col("parent").alias("child"), F.lit(True).alias("inner")).distinct()
    return e.join(inner, "child", "left").groupBy(F.col("parent").alias("node")).agg(F.count_if(F.col("inner").isNotNull()).alias("inner_children"), F.count_if(F.col("inner").isNull()).alias("leaf_children"))


@query("ancestors_to_relabel", f"WITH RECURSIVE {EDGES}, a AS (SELECT DISTINCT 'c' || o_custkey AS node FROM orders WHERE o_orderstatus = 'F' UNION SELECT e.parent FROM a JOIN e ON e.child = a.node) SELECT node FROM a")
def ancestors_to_relabel(t: Tables):
    hit = t("orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("c"), "o_custkey").alias("node"))
    return hierarchy.ancestors(edges(t), hit)


@query("level_collapse", "SELECT r_name AS name, CASE WHEN (SELECT count(*) FROM nation) <= 3 THEN 'L1' ELSE 'L2' END AS level FROM region")
def level_collapse(t: Tables):
    n = t("nation").agg(F.count(F.lit(1)).alias("n"))
    return t("region").join(F.broadcast(n)).select(F.col("r_name").alias("name"), F.when(F.col("n") <= 3, "L1").otherwise("L2").alias("level"))


@query("schema_lines", "SELECT line FROM (SELECT r_name AS line FROM region WHERE (SELECT count(*) FROM region) > 1 UNION ALL SELECT n_name FROM nation WHERE (SELECT count(*) FROM region) = 1)")
def schema_lines(t: Tables):
    n = F.broadcast(t("region").agg(F.count(F.lit(1)).alias("n")))
    return t("region").join(n).filter("n > 1").select(F.col("r_name").alias("line")).unionByName(t("nation").join(n).filter("n = 1").select(F.col("n_name").alias("line")))


@query("coverage_preserved", "SELECT o_orderkey, coalesce(sum(l_quantity), 0) >= 100 AS preserved FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def coverage_preserved(t: Tables):
    child = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return t("orders").select("o_orderkey").join(child, "o_orderkey", "left").select("o_orderkey", (F.coalesce("q", F.lit(0.0)) >= 100).alias("preserved"))


# Line numbers of an order are the steps of a run; each depends on the one before it.
STATUS = "CASE WHEN l_returnflag = 'R' THEN 'done' WHEN l_returnflag = 'A' THEN 'skipped' ELSE 'pending' END"
STEPS = f"s AS (SELECT l_orderkey AS run, l_linenumber AS step, max({STATUS}) AS status FROM lineitem GROUP BY 1, 2), d AS (SELECT run, step, lag(step) OVER (PARTITION BY run ORDER BY step) AS dep FROM s)"


def steps(t: Tables):
    status = F.when(F.col("l_returnflag") == "R", "done").when(F.col("l_returnflag") == "A", "skipped").otherwise("pending")
    return t("lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step")).agg(F.max(status).alias("status"))


def deps(t: Tables):
    return steps(t).select("run", "step", F.lag("step").over(Window.partitionBy("run").orderBy("step")).alias("dep"))


@query("ready_steps", f"WITH {STEPS} SELECT s.run, s.step FROM s WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM d LEFT JOIN s x ON x.run = d.run AND x.step = d.dep WHERE d.run = s.run AND d.step = s.step AND d.dep IS NOT NULL AND coalesce(x.status <> 'done', true))")
def ready_steps(t: Tables):
    return planner.ready(steps(t), deps(t).filter("dep is not null"))


@query("missing_deps", f"WITH {STEPS} SELECT d.run, d.step, d.dep + 1 AS dep FROM d WHERE d.dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.run = d.run AND s.step = d.dep + 1)")
def missing_deps(t: Tables):
    asked = deps(t).filter("dep is not null").select("run", "step", (F.col("dep") + 1).alias("dep"))
    return asked.join(steps(t).select("run", F.col("step").alias("dep")), ["run", "dep"], "left_anti").select("run", "step", "dep")


@query("dag_cycles", f"WITH {STEPS} SELECT run FROM s GROUP BY run HAVING count(*) >= 2 AND run % 3 = 0")
def dag_cycles(t: Tables):
    """Runs divisible by three get a link from their first step to their last, which closes a cycle where there are two."""
    back = steps(t).filter("run % 3 = 0").groupBy("run").agg(F.min("step").alias("step"), F.max("step").alias("dep")).filter("step <> dep")
    return planner.cyclic(deps(t).unionByName(back))


@query("replan_carry", f"WITH {STEPS}, n AS (SELECT run, step FROM s WHERE step % 2 = 1 UNION ALL SELECT run, max(step) + 1 FROM s GROUP BY run) SELECT n.run, n.step, CASE WHEN s.status IN ('done', 'skipped') THEN s.status ELSE 'pending' END AS status FROM n LEFT JOIN s ON s.run = n.run AND s.step = n.step")
def replan_carry(t: Tables):
    s = steps(t)
    new = s.filter("step % 2 = 1").select("run", "step").unionByName(s.groupBy("run").agg((F.max("step") + 1).alias("step")).select("run", "step"))
    return planner.replan(s, new)


RUNS = """s AS (SELECT l_orderkey AS run, l_linenumber AS step, max(CASE WHEN l_discount > 0.08 THEN 'failed' WHEN l_returnflag = 'R' THEN 'done' WHEN l_returnflag = 'A' THEN 'skipped' ELSE 'pending' END) AS status,
  max(CASE WHEN l_linenumber % 3 = 0 THEN 'reason' ELSE 'tool' END) AS kind, max(CASE WHEN l_quantity > 10 THEN 'w' END) AS capability, max(l_linestatus) AS got FROM lineitem GROUP BY 1, 2),
x AS (SELECT s.run, count(*) AS n, count(*) FILTER (WHERE status IN ('done', 'skipped')) AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE kind <> 'reason') AS exec,
  count(*) FILTER (WHERE kind <> 'reason' AND capability IS NOT NULL) AS grounded, count(*) FILTER (WHERE step % 2 = 1) AS checked, count(*) FILTER (WHERE step % 2 = 1 AND got = o_orderstatus) AS matched FROM s JOIN orders ON o_orderkey = s.run GROUP BY s.run),
y AS (SELECT *, (run % 5 = 0)::INT AS missing, (run % 7 = 0 AND n >= 2)::INT AS cyc FROM x),
e AS (SELECT run, missing + cyc + exec - grounded + checked - matched AS faults, round(0.3 * done / n + 0.2 * greatest(0, 1 - (missing + cyc) / n) + 0.2 * CASE WHEN checked > 0 THEN matched / checked ELSE 1 END + 0.15 * CASE WHEN exec > 0 THEN grounded / exec ELSE 1 END
  + 0.1 * CASE WHEN run % 2 = 0 THEN (failed = 0)::INT ELSE greatest(0, 1 - failed / n) END + 0.05 * CASE WHEN run % 3 = 0 THEN (run % 4) / 4 ELSE 1 END, 6) AS score FROM y)"""


def evaluated(t: Tables):
    """Orders as runs: lines are steps of a chain. A fifth of the runs depends on a step that is not there, a seventh on its own
    end; observed states are the line's, expected ones the order's, of every other step."""
    status = F.when(F.col("l_discount") > 0.08, "failed").when(F.col("l_returnflag") == "R", "done").when(F.col("l_returnflag") == "A", "skipped").otherwise("pending")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "reason").otherwise("tool")
    known = t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("value"))
    s = t("lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step")).agg(F.max(status).alias("status"), F.max(kind).alias("kind"), F.max(F.when(F.col("l_quantity") > 10, "w")).alias("capability"), F.max("l_linestatus").alias("got"))
    s = stored(s.join(known.select("run"), "run", "left_semi"), "steps")
    ends = s.groupBy("run").agg(F.min("step").alias("step"), F.max("step").alias("last"))
    chain = s.select("run", "step", F.lag("step").over(Window.partitionBy("run").orderBy("step")).alias("dep"))
    lost = ends.filter("run % 5 = 0").select("run", "step", (F.col("last") + 1).alias("dep"))
    back = ends.filter("run % 7 = 0 and step <> last").select("run", "step", F.col("last").alias("dep"))
    told = lambda v: F.explode(F.create_map(F.lit("status"), v)).alias("key", "value")
    expected = s.join(known, "run").select("run", "step", told(F.col("value")))
    observed = s.filter("step % 2 = 1").select("run", "step", told(F.col("got")))
    plans = ends.select("run", (1 + F.col("run") % 2).alias("version"), F.when(F.col("run") % 3 == 0, F.col("run") % 4 / 4).alias("efficiency"))
    return runs.evaluate(s, chain.unionByName(lost).unionByName(back), expected, observed, plans)


@query("plan_quality", f"WITH {RUNS} SELECT run, score, faults FROM e")
def plan_quality(t: Tables):
    return evaluated(t).select("run", "score", "faults")


@query("finalize_runs", f"WITH {RUNS} SELECT run, CASE WHEN faults = 0 THEN 'completed' ELSE 'failed' END AS status FROM e")
def finalize_runs(t: Tables):
    return runs.finalize(evaluated(t))


@query("planner_benchmark")
def planner_benchmark(t: Tables):
    """Turns of conversations as cases of the planning benchmark: its six components, score and verdict."""
    strings = lambda *x: F.array(*map(F.lit, x))
    cases = t("conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("query"), F.lit(2).alias("min_steps"), F.lit(4).alias("max_steps"), strings("validate", "tool").alias("kinds"),
        strings("request", "result").alias("terms"), strings("must", "by").alias("constraints"), strings("query may contain branching choices").alias("notes"), F.lit(2).alias("min_grounded"), F.lit(0.7).alias("floor"),
    )
    return runs.benchmark(cases, CAPABILITIES)


@query("state_fold", "WITH v AS (SELECT user_id AS run, event_type AS key, arg_max(value, event_id) AS value, arg_max(event_id % 11 = 0, event_id) AS gone FROM events GROUP BY 1, 2) SELECT run, key, CAST(round(value * 1000) AS BIGINT) AS value FROM v WHERE NOT gone")
def state_fold(t: Tables):
    """The state after a log in which every eleventh event sets its key and removes it again."""
    e = t("events")
    log = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.create_map("event_type", F.round(F.col("value") * 1000).cast("long").cast("string")).alias("set"), F.when(F.col("event_id") % 11 == 0, F.array("event_type")).alias("remove"))
    return runs.fold_state(log)[0].select("run", "key", F.col("value").cast("long").alias("value"))


@query("state_transitions", "WITH x AS (SELECT o_orderkey AS run, 'status' AS key, o_orderstatus AS expected FROM orders), o AS (SELECT l_orderkey AS run, 'status' AS key, max(l_linestatus) AS observed FROM lineitem GROUP BY 1) SELECT x.run, x.key, expected = observed AS matched FROM x JOIN o ON o.run = x.run AND o.key = x.key")
def state_transitions(t: Tables):
    x = t("orders").select(F.col("o_orderkey").alias("run"), F.explode(F.create_map(F.lit("status"), F.col("o_orderstatus"))).alias("key", "expected"))
    o = t("lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.max("l_linestatus").alias("s")).select("run", F.explode(F.create_map(F.lit("status"), F.col("s"))).alias("key", "observed"))
    return x.join(o, ["run", "key"]).select("run", "key", (F.col("expected") == F.col("observed")).alias("matched"))


# The capabilities that steps are grounded in.
CAPABILITIES = [("web_search", "search find and retrieve click pages"), ("text_generation", "write draft text"), ("workspace_action", "run update purchase signup"), ("validator", "validate check error")]


@query("ground_steps", """WITH c(pos, id, words) AS (VALUES (0, 'web_search', ['web','search','find','and','retrieve','click','pages']), (1, 'text_generation', ['text','generation','write','draft']), (2, 'workspace_action', ['workspace','action','run','update','purchase','signup']), (3, 'validator', ['validator','validate','check','error'])),
w AS (SELECT event_id, list_distinct(list_filter(string_split(event_type || ' and check', ' '), lambda x: x <> '')) AS ws FROM events),
s AS (SELECT event_id, id, len(list_intersect(ws, words)) / len(ws) AS score, row_number() OVER (PARTITION BY event_id ORDER BY len(list_intersect(ws, words)) / len(ws) DESC, pos) AS n FROM w, c)
SELECT event_id, CASE WHEN score > 0 THEN id END AS capability, CASE WHEN score > 0 THEN round(score, 6) END AS score FROM s WHERE n = 1""")
def ground_steps(t: Tables):
    asked = t("events").select("event_id", F.concat("event_type", F.lit(" and check")).alias("text"), F.lit(None).cast("string").alias("hint"))
    return planner.ground(asked, CAPABILITIES).select("event_id", "capability", "score")


@query("symbolic_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'pay' END AS action FROM events")
def symbolic_lookup(t: Tables):
    known = t.spark.createDataFrame([("click", "open"), ("purchase", "pay")], "event_type string, action string")
    return t("events").join(F.broadcast(known), "event_type", "left").select("event_id", "action")


@query("feedback_log", "SELECT user_id AS run, event_id AS seq, event_type AS key, value FROM events")
def feedback_log(t: Tables):
    return t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), "value")


@query("plan_versions", "SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS version, event_id FROM events WHERE event_type = 'error'")
def plan_versions(t: Tables):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").filter("event_type = 'error'").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("version"), "event_id")


WORLD = "SELECT user_id AS run, event_type AS key, arg_max(value, event_id) AS value, count(*) AS revision FROM events GROUP BY 1, 2"


@query("world_state", WORLD)
def world_state(t: Tables):
    return planner.last_values(feedback_log(t), "run", "key", "value", "seq")


@query("world_state_stream", WORLD)
def world_state_stream(t: Tables):
    """The same fold as a stream, run over all events in batches."""
    base = f"{shared_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = t("events").schema
    src = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet" if len(t("events").inputFiles()) > 1 else f"{t.folder}/events.parquet*")
    log = src.select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("seq"))
    feedback.run_once(feedback.fold(log), f"{base}/out", f"{base}/checkpoint", "update")
    return feedback.read_latest(t.spark, f"{base}/out", ["run", "key"], ["value", "revision"])


@query("step_status_fold", "SELECT user_id AS run, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END, event_id) AS status FROM events GROUP BY 1")
def step_status_fold(t: Tables):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("running")
    return t("events").groupBy(F.col("user_id").alias("run")).agg(F.max_by(status, "event_id").alias("status"))


@query("build_context", "SELECT run, list(event_id ORDER BY event_id DESC) AS recent FROM (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5 GROUP BY run")
def build_context(t: Tables):
    w = Window.partitionBy("run").orderBy(F.desc("event_id"))
    last = t("events").select(F.col("user_id").alias("run"), "event_id").withColumn("n", F.row_number().over(w)).filter("n <= 5")
    return last.groupBy("run").agg(F.sort_array(F.collect_list("event_id"), asc=False).alias("recent"))


JOIN = "SELECT c_custkey, o_orderkey FROM customer {} JOIN orders ON o_custkey = c_custkey"
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("full", "FULL")):

    @query(f"ext_join_{_how}", JOIN.format(_sql))
    def _join(t: Tables, how: str = _how):
        return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), how).select("c_custkey", "o_orderkey")


for _how, _sql in (("semi", ""), ("anti", "NOT ")):

    @query(f"ext_join_{_how}", f"SELECT c_custkey FROM customer WHERE {_sql}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    def _half(t: Tables, how: str = _how):
        return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), f"left_{how}").select("c_custkey")


@query("ext_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ext_rollup(t: Tables):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(t: Tables):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("ext_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def ext_grouping_sets(t: Tables):
    cols = [F.col("l_returnflag"), F.col("l_linestatus")]
    return t("lineitem").groupingSets([[cols[0]], [cols[1]], []], *cols).agg(F.count(F.lit(1)).alias("n"))


@query("ext_distinct_agg", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def ext_distinct_agg(t: Tables):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("ext_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS r FROM orders")
def ext_rank(t: Tables):
    return t("orders").select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))).alias("r"))


@query("ext_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean FROM orders")
def ext_frame(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return t("orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("mean"))


@query("ext_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(t: Tables):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("ext_except", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def ext_except(t: Tables):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("ext_asof", "SELECT c.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts")
def ext_asof(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return t("events").filter(F.col("event_type").isin("click", "purchase")).withColumn("purchase", last).filter("event_type = 'click'").select("event_id", "purchase")


@query("ext_join_range", "SELECT a.event_id AS error_id, b.event_id AS near_id FROM events a JOIN events b ON a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 5 MINUTE")
def ext_join_range(t: Tables):
    """Pairs within five minutes: an equi join on five-minute buckets, each error also in the next, then the exact bounds."""
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 300_000_000)
    a = t("events").filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("at"), F.explode(F.array(bucket(F.col("ts")), bucket(F.col("ts")) + 1)).alias("b"))
    p = t("events").filter("event_type = 'purchase'").select(F.col("event_id").alias("near_id"), "ts", bucket(F.col("ts")).alias("b"))
    return a.join(p, "b").filter(F.col("ts").between(F.col("at"), F.col("at") + F.expr("INTERVAL 5 MINUTES"))).select("error_id", "near_id")


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(t: Tables):
    return feedback.tumbling(t("events"), "1 hour", "10 minutes")


@query("ext_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, count(*) AS n FROM events, range(2) r(k) GROUP BY 1")
def ext_sliding(t: Tables):
    return t("events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("ext_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def ext_session(t: Tables):
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("ext_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ext_json_props(t: Tables):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("ext_topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def ext_topk_per_group(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey")


@query("best_first_search")
def best_first_search(t: Tables):
    """From each region towards a customer of a large balance: 64 expansions in sequence, so rows only."""
    scored = t("customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 10_000).alias("score"))
    nations = scored.groupBy("c_nationkey").agg(F.round(F.avg("score"), 6).alias("score"))
    down = t("nation").join(nations, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), "score", F.col("n_nationkey").cast("long").alias("pos"), F.lit(False).alias("terminal"))
    leaf = scored.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), "score", F.col("c_custkey").alias("pos"), (F.col("score") >= 0.99).alias("terminal"))
    roots = t("region").select(F.col("r_name").alias("search"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(0.0).alias("score"), F.lit(False).alias("terminal"))
    return search.best_first(roots, down.unionByName(leaf))
