"""Runs of plans: folds of their logs, evaluation, finalisation, and the benchmark of planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from . import planner

# Weights of the benchmark's components.
BENCHMARK = {"step_range": 0.20, "kind_coverage": 0.20, "term_coverage": 0.25, "constraint_recall": 0.15, "ambiguity_recall": 0.05, "grounding_coverage": 0.15}


def fold_state(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, key, value) after the log, and (run, revision). log: run, seq, set map<string,string>, remove array<string>.

    An event sets its keys, then removes those it names; the last event of a key counts. The revision counts events that
    set or remove something. One partial maximum a key, no sort; null maps and lists are empty.
    """
    put = log.select("run", "seq", F.explode("set").alias("key", "value")).select("run", "key", F.struct("seq", F.lit(0).alias("gone"), "value").alias("e"))
    drop = log.select("run", "seq", F.explode("remove").alias("key")).select("run", "key", F.struct("seq", F.lit(1).alias("gone"), F.lit(None).cast("string").alias("value")).alias("e"))
    last = put.unionByName(drop).groupBy("run", "key").agg(F.max_by("e", F.struct("e.seq", "e.gone")).alias("e"))
    some = (F.coalesce(F.size("set"), F.lit(0)) > 0) | (F.coalesce(F.size("remove"), F.lit(0)) > 0)
    return last.filter("e.gone = 0").select("run", "key", "e.value"), log.groupBy("run").agg(F.count_if(some).alias("revision"))


def fold_steps(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, step, status, summary) and (run, step, artifact, name, payload) after a log of (run, seq, step, what, summary,
    artifacts array<struct<name,payload>>).

    what is running, complete or fail; a step's last event gives its status, and its last complete or fail the summary.
    An artifact is named by its step and its place among all of the run.
    """
    status = F.when(F.col("what") == "complete", "done").when(F.col("what") == "fail", "failed").otherwise("running")
    ended = F.when(F.col("what") != "running", F.col("seq"))
    states = log.groupBy("run", "step").agg(F.max_by(status, "seq").alias("status"), F.max_by("summary", ended).alias("summary"))
    made = log.filter((F.col("what") == "complete") & (F.size("artifacts") > 0))
    before = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("base", F.coalesce(F.sum(F.size("artifacts")).over(before), F.lit(0)))
    each = made.select("run", "step", "base", F.posexplode("artifacts").alias("i", "a"))
    return states, each.select("run", "step", F.concat("step", F.lit("-artifact-"), (F.col("base") + F.col("i") + 1).cast("string")).alias("artifact"), "a.name", "a.payload")


def evaluate(steps: DataFrame, deps: DataFrame, expected: DataFrame, observed: DataFrame, plans: DataFrame) -> DataFrame:
    """(run, score, passed, issues and the counts that make them) of plans (run, version, efficiency, null where not known).

    steps: run, step, kind, status, capability (null where not grounded). deps: run, step, dep. expected and observed:
    run, step, key, value. Issues are dependencies on steps that are not there, a cycle, executable steps that are not
    grounded (all but kind reason) and observed values that are not the expected ones; a key not observed is not checked.
    """
    base = plans.select("run", "version", "efficiency")
    own = steps.groupBy("run").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("status").isin("done", "skipped")).alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("kind") != "reason").alias("executable"),
        F.count_if((F.col("kind") != "reason") & F.col("capability").isNotNull()).alias("grounded"),
    )
    asked = deps.filter("dep is not null").join(steps.select("run", "step"), ["run", "step"], "left_semi").distinct()
    known = steps.select("run", F.col("step").alias("dep"))
    missing = asked.join(known, ["run", "dep"], "left_anti").groupBy("run").agg(F.count(F.lit(1)).alias("missing"))
    cycles = planner.cyclic(asked.join(known, ["run", "dep"], "left_semi")).withColumn("cycle", F.lit(1))
    there = steps.select("run", "step")
    both = expected.join(observed.withColumnRenamed("value", "got"), ["run", "step", "key"]).join(there, ["run", "step"], "left_semi")
    moved = both.groupBy("run").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("value").eqNullSafe(F.col("got"))).alias("matched"))
    out = base
    for part in (own, missing, cycles, moved):
        out = out.join(part, "run", "left")
    out = out.fillna(0, ["steps", "done", "failed", "executable", "grounded", "missing", "cycle", "checked", "matched"])
    scored = planner.quality(out.withColumn("issues", F.col("missing") + F.col("cycle")))
    faults = F.col("missing") + F.col("cycle") + (F.col("executable") - F.col("grounded")) + (F.col("checked") - F.col("matched"))
    return scored.withColumn("faults", faults).withColumn("passed", F.col("faults") == 0).drop("issues", "efficiency")


def finalize(evaluated: DataFrame) -> DataFrame:
    """(run, status): completed where the plan has no issue, else failed."""
    return evaluated.select("run", F.when(F.col("passed"), "completed").otherwise("failed").alias("status"))


def benchmark(cases: DataFrame, capabilities: list[tuple[str, str]]) -> DataFrame:
    """(id, passed, score, step_count and the six components) of cases.

    cases: id, query, min_steps, max_steps, kinds, terms, constraints, notes (array<string>, null or empty: nothing is
    asked), min_grounded, floor (null: 0 and 0.7). The plan is that of `planner.build_plan`; a step's text is its title
    and its instructions.
    """
    plans = planner.build_plan(cases, "id", "query")
    named = plans.withColumn("text", F.concat_ws(" ", text.title(F.col("instructions"), F.lit("")), F.col("instructions")))
    steps = planner.ground(named, capabilities)
    per = steps.groupBy("id").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.collect_set("kind").alias("has_kinds"),
        F.lower(F.array_join(F.collect_list("text"), " ")).alias("said"),
        F.count_if(F.col("kind") != "reason").alias("executable"),
        F.count_if((F.col("kind") != "reason") & F.col("capability").isNotNull()).alias("grounded"),
    )
    c = cases.join(per, "id")
    low = lambda a: F.transform(a, F.lower)

    def share(asked: str, hit) -> Column:
        n = F.coalesce(F.size(asked), F.lit(0))
        return F.when(n > 0, F.size(F.filter(asked, hit)) / n).otherwise(1.0)

    own, notes = low(text.constraints(F.col("query"))), low(text.ambiguities(F.col("query")))
    need = F.coalesce("min_grounded", F.lit(0))
    actual = F.col("grounded") / F.greatest("executable", F.lit(1))
    enough = F.when(need > 0, F.least(actual, F.col("grounded") / F.greatest(need, F.lit(1)))).otherwise(actual)
    parts = {
        "step_range": F.when(F.col("step_count").between(F.col("min_steps"), F.col("max_steps")), 1.0).otherwise(0.0),
        "kind_coverage": share("kinds", lambda x: F.array_contains("has_kinds", x)),
        "term_coverage": share("terms", lambda x: F.contains(F.col("said"), F.lower(x))),
        "constraint_recall": share("constraints", lambda x: F.exists(own, lambda o: F.contains(o, F.lower(x)))),
        "ambiguity_recall": share("notes", lambda x: F.array_contains(notes, x)),
        "grounding_coverage": F.when(F.col("executable") == 0, 1.0).otherwise(F.least(F.lit(1.0), enough)),
    }
    scored = c.select("id", "step_count", F.coalesce("floor", F.lit(0.7)).alias("floor"), *[v.alias(n) for n, v in parts.items()])
    total = sum((F.lit(w) * F.col(n) for n, w in BENCHMARK.items()), F.lit(0.0))
    return scored.select("id", (F.round(total, 9) >= F.col("floor")).alias("passed"), F.round(total, 6).alias("score"), "step_count", *parts)
