"""Plans: steps from a request, what is ready, folds of feedback, replans and the quality of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.store import stored

# Weights of a plan's quality.
WEIGHTS = {"task_success": 0.30, "validity": 0.20, "transitions": 0.20, "grounding": 0.15, "recovery": 0.10, "search": 0.05}


def build_plan(requests: DataFrame, key: str, column: str) -> DataFrame:
    """(key, step_id, dep, kind, hint, instructions): a chain of the request's parts with a validation behind it; three
    fixed steps where there is one part or none."""
    parts = requests.select(key, F.col(column).alias("q"), text.split_steps(F.col(column)).alias("ps"))
    step = lambda i, p: F.struct(F.concat(F.lit("step_"), (i + 1).cast("string")).alias("step_id"), F.when(i > 0, F.concat(F.lit("step_"), i.cast("string"))).alias("dep"), text.first_class(p, text.STEP_KINDS, "reason").alias("kind"), text.first_class(p, text.CAPABILITY_HINTS, None).alias("hint"), p.alias("instructions"))
    fixed = lambda a, b, c, d, e: F.struct(a.alias("step_id"), b.alias("dep"), c.alias("kind"), d.alias("hint"), e.alias("instructions"))
    none = F.lit(None).cast("string")
    last = fixed(F.lit("validate_response"), F.concat(F.lit("step_"), F.size("ps").cast("string")), F.lit("validate"), F.lit("validator"), F.lit("Review completed subtasks, verify dependency integrity, and prepare the final response."))
    single = F.array(
        fixed(F.lit("analyze_request"), none, F.lit("reason"), none, F.concat(F.lit("Interpret the request and identify required subtasks for: "), "q")),
        fixed(F.lit("execute_request"), F.lit("analyze_request"), F.lit("tool"), text.first_class(F.col("q"), text.CAPABILITY_HINTS, None), F.concat(F.lit("Carry out the main requested work for: "), "q")),
        fixed(F.lit("validate_response"), F.lit("execute_request"), F.lit("validate"), F.lit("validator"), F.lit("Check that the result satisfies the request and produce the final summary.")),
    )
    steps = F.when(F.size("ps") <= 1, single).otherwise(F.concat(F.transform("ps", lambda p, i: step(i, p)), F.array(last)))
    return parts.select(key, F.inline(steps))


def start_runs(requests: DataFrame, key: str, column: str, capabilities: list[tuple[str, str]], reason: str = "initial plan") -> tuple[DataFrame, DataFrame]:
    """(plans: run, plan, version, parent, reason; steps: run, plan, version, step, dep, kind, capability, status) of new runs.

    Run and plan are named by a hash of the key, so a task that is run again names them alike. Steps begin pending.
    """
    name = lambda kind: F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("::", F.lit(kind), F.col(key).cast("string")), 256), 1, 12))
    ids = [name("run").alias("run"), name("plan").alias("plan"), F.lit(1).alias("version")]
    steps = build_plan(requests, key, column).withColumn("text", F.col("instructions"))
    steps = ground(steps, capabilities).select(*ids, F.col("step_id").alias("step"), "dep", "kind", "capability", F.lit("pending").alias("status"))
    return requests.select(*ids, F.lit(None).cast("int").alias("parent"), F.lit(reason).alias("reason")), steps


def ready(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """Steps (run, step, status) that are not running or over and whose dependencies (run, step, dep) are all exactly done."""
    state = steps.select("run", F.col("step").alias("dep"), F.col("status").alias("ds"))
    blocked = deps.join(state, ["run", "dep"], "left").filter(~F.coalesce(F.col("ds") == "done", F.lit(False))).select("run", "step").distinct()
    return steps.filter(~F.col("status").isin("done", "failed", "running", "skipped")).join(blocked, ["run", "step"], "left_anti").select("run", "step")


def ground(steps: DataFrame, capabilities: list[tuple[str, str]]) -> DataFrame:
    """steps (…, text, hint) with the best capability (id, description): the share of the step's words it has, 1 more where the
    hint names it, the first of equals; null where no score is above 0."""
    words = text.set_tokens(F.col("text"))
    scored = F.array(*[F.struct((F.size(F.array_intersect(words, text.set_tokens(F.lit(f"{c} {d}")))) / F.greatest(F.size(words), F.lit(1)) + F.when(F.col("hint") == c, 1.0).otherwise(0.0)).alias("score"), F.lit(-i).alias("pos"), F.lit(c).alias("id")) for i, (c, d) in enumerate(capabilities)])
    best = F.array_max(scored)
    return steps.withColumn("capability", F.when(best["score"] > 0, best["id"])).withColumn("score", F.when(best["score"] > 0, F.round(best["score"], 6)))


def last_values(events: DataFrame, run: str, key: str, value: str, order: str) -> DataFrame:
    """(run, key, value, revision) of a log: the last value of each key, and how often it was set. One partial maximum, no sort."""
    return events.groupBy(run, key).agg(F.max_by(value, order).alias("value"), F.count(F.lit(1)).alias("revision"))


def replan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(run, step, status) of the new plan: done and skipped steps of the old one keep their status, others are pending."""
    kept = old.filter(F.col("status").isin("done", "skipped")).select("run", "step", F.col("status").alias("kept"))
    return new.join(kept, ["run", "step"], "left").select("run", "step", F.coalesce("kept", F.lit("pending")).alias("status"))


def cyclic(deps: DataFrame) -> DataFrame:
    """Runs whose dependencies (run, step, dep) have a cycle: steps without open dependencies go, round by round, until none does."""
    left = stored(deps.select("run", "step", "dep").filter("dep is not null").distinct(), "deps")
    while True:
        open_ = left.select("run", F.col("step").alias("dep")).distinct()
        rest = stored(left.join(open_, ["run", "dep"], "left_semi").select("run", "step", "dep"), "deps")
        n = rest.count()
        if n == 0 or n == left.count():
            return rest.select("run").distinct()
        left = rest


def quality(plans: DataFrame) -> DataFrame:
    """plans (run, steps, done, failed, issues, matched, checked, grounded, executable, version, efficiency) with score, round to 6."""

    def share(a, b, other):
        return F.when(b > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), a / b))).otherwise(F.lit(other))

    c = {n: F.col(n) for n in plans.columns}
    parts = {
        "task_success": share(c["done"], c["steps"], 0.0),
        "validity": F.when(c["steps"] > 0, F.greatest(F.lit(0.0), 1 - c["issues"] / c["steps"])).otherwise(0.0),
        "transitions": share(c["matched"], c["checked"], 1.0),
        "grounding": share(c["grounded"], c["executable"], 1.0),
        "recovery": F.when(c["version"] <= 1, F.when(c["failed"] == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - c["failed"] / F.greatest(c["steps"], F.lit(1)))),
        "search": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c["efficiency"], F.lit(1.0)))),
    }
    return plans.withColumn("score", F.round(sum((F.lit(w) * parts[n] for n, w in WEIGHTS.items()), F.lit(0.0)), 6))
