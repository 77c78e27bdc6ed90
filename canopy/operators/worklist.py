"""Refinement of weak steps, circle by circle, of many requests at once, and the modes of answering a request."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.store import stored
from .retrieve import decision, union_pool

#: Refinements of one request, and circles of the two refining modes.
BUDGET = 20
CIRCLES = {"refined_decompose": 2, "recursive_decompose": 3}

STEP = "q, place, parent, circle, text, expected"


@dataclass(frozen=True)
class Worked:
    """traces: q, place, parent, circle, text, expected, decision, reason, top_score, margin, leaves; pool: q, rank, leaf, score."""

    traces: DataFrame
    pool: DataFrame


def children(refined: DataFrame, most: int = 8) -> DataFrame:
    """Of (q, place, text, parts array<struct<text,expected>>) the parts without blank ones, those equal to the step's text
    and repeats, but for case and outer blanks; `most` at most."""
    key = lambda s: F.lower(F.btrim(s["text"]))
    good = F.filter("parts", lambda s: s["text"].isNotNull() & (key(s) != "") & (key(s) != F.lower(F.btrim(F.col("text")))))
    once = F.filter(good, lambda s, i: ~F.exists(F.slice(good, F.lit(1), i), lambda o: key(o) == key(s)))
    return refined.withColumn("parts", F.slice(once, 1, most))


def work(steps: DataFrame, retrieve: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame], mode: str, k: int = 10, circles: int | None = None, budget: int = BUDGET, many: Callable[[Column], Column] = text.many_intents) -> Worked:
    """Retrieve steps, split the weak ones and retrieve their parts, until none is weak or the limits end it.

    steps: q, pos, text, expected. retrieve maps (q, place, text) to (q, place, rank from 1, leaf, score). refine maps
    (q, place, text, expected, reason) to (q, place, parts array<struct<text,expected>>), null or empty where it has none.
    A weak step is refined where circle + 1 < circles and fewer than `budget` steps of its request were refined before,
    in the order of a queue: circle, then the order of the steps that they come from. Else it is unresolved, its reason
    with _max_circles or _max_refinements. Refinements without a part, or whose parts expect fewer leaves than their step,
    end as unresolved with refine_empty. In the mode refined_decompose every step's list is pooled by rank; in
    recursive_decompose the best leaf of each resolved step counts, by its score.

    All requests go through a circle in one batch, which is stored; a circle is one call of retrieve and one of refine.
    Null texts are never retrieved and drop out; requests without steps give no rows.
    """
    circles = CIRCLES[mode] if circles is None else circles
    now = steps.filter("text is not null").select("q", F.array(F.col("pos").cast("int")).alias("place"), F.lit(None).cast("array<int>").alias("parent"), F.lit(0).alias("circle"), "text", F.col("expected").cast("int").alias("expected"))
    now, used, traces, lists = stored(now, "steps"), None, None, None
    for circle in range(max(circles, 1)):
        if now.isEmpty():
            break
        got = stored(retrieve(now.select("q", "place", "text")).select("q", "place", "rank", "leaf", "score"), "retrieved")
        best = got.groupBy("q", "place").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
        seen = now.join(best, ["q", "place"], "left").withColumn("margin", F.col("top_score") - F.col("second")).drop("second")
        seen = seen.withColumn("d", decision(F.col("expected"), F.col("top_score"), F.col("margin"), F.coalesce(many(F.col("text")), F.lit(False)))).select("*", "d.decision", "d.reason").drop("d")
        turn = F.row_number().over(Window.partitionBy("q", F.col("decision") == "refine").orderBy("place"))
        seen = seen.withColumn("turn", F.when(F.col("decision") == "refine", turn))
        if used is not None:
            seen = seen.join(used, "q", "left").withColumn("turn", F.col("turn") + F.coalesce("used", F.lit(0))).drop("used")
        last = F.lit(circle + 1 >= circles)
        why = F.when(F.col("decision") != "refine", F.col("reason")).when(last, F.concat("reason", F.lit("_max_circles"))).when(F.col("turn") > budget, F.concat("reason", F.lit("_max_refinements"))).otherwise(F.col("reason"))
        open_ = (F.col("decision") == "refine") & ~last & (F.col("turn") <= budget)
        seen = stored(seen.withColumn("open", open_).withColumn("reason", why).withColumn("decision", F.when((F.col("decision") == "refine") & ~F.col("open"), "unresolved").otherwise(F.col("decision"))), "decided")
        weak = seen.filter("open")
        down = None
        if circle + 1 < circles and not weak.isEmpty():
            parts = refine(weak.select("q", "place", "text", "expected", "reason")).select("q", "place", "parts")
            down = children(weak.join(parts, ["q", "place"], "left"))
            enough = F.aggregate("parts", F.lit(0), lambda a, s: a + s["expected"].cast("int")) >= F.col("expected")
            down = stored(down.select("q", "place", "parts", (F.coalesce(F.size("parts"), F.lit(0)) > 0).alias("some"), F.coalesce(enough, F.lit(False)).alias("enough")), "refined")
            kept = down.filter("some and enough")
            empty = down.filter("not (some and enough)").select("q", "place", F.lit(True).alias("empty"))
            seen = seen.join(empty, ["q", "place"], "left").withColumn("reason", F.when(F.col("empty"), "refine_empty").otherwise(F.col("reason"))).withColumn("decision", F.when(F.col("empty"), "unresolved").otherwise(F.col("decision"))).drop("empty")
            spent = weak.groupBy("q").agg(F.max("turn").alias("used"))
            used = stored(spent if used is None else used.unionByName(spent).groupBy("q").agg(F.max("used").alias("used")), "used")
            now = stored(kept.select("q", "place", F.posexplode("parts").alias("i", "s")).select("q", F.concat("place", F.array("i")).alias("place"), F.col("place").alias("parent"), F.lit(circle + 1).alias("circle"), F.btrim("s.text").alias("text"), F.col("s.expected").cast("int").alias("expected")), "steps")
        else:
            now = now.limit(0)
        one = seen.drop("turn", "open")
        traces = one if traces is None else traces.unionByName(one)
        lists = got if lists is None else lists.unionByName(got)
    if traces is None:
        none = steps.sparkSession
        return Worked(none.createDataFrame([], "q long, place array<int>, parent array<int>, circle int, text string, expected int, top_score double, leaves array<string>, margin double, decision string, reason string"), none.createDataFrame([], "q long, rank int, leaf string, score double"))
    traces = stored(traces, "traces")
    if mode == "refined_decompose":
        order = traces.select("q", "place", F.struct("circle", "place").alias("sub"))
        pool = union_pool(lists.join(order, ["q", "place"]).select("q", "sub", (F.col("rank") - 1).alias("rank"), "leaf"), k, k)
    else:
        firsts = lists.filter("rank = 1").join(traces.filter("decision = 'resolved'").select("q", "place", "circle"), ["q", "place"])
        best_of = firsts.groupBy("q", "leaf").agg(F.max("score").alias("score"), F.min(F.struct("circle", "place")).alias("seen"))
        w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "seen")
        pool = best_of.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "rank", "leaf", "score")
    return Worked(traces, pool)


def answer(requests: DataFrame, mode: str, retrieve: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame] | None = None, refine: Callable[[DataFrame], DataFrame] | None = None, inject: Callable[[Column, Column], Column] | None = None, k: int = 10) -> DataFrame:
    """(q, rank, leaf, score) of requests (q, text) by one of the modes of `plans.prompts.mode`.

    direct retrieves the text as it is. The others take the steps that split gives: (q, parts array<struct<text,expected>>).
    decompose and dependency_hinted_decompose pool the lists of all parts, and decompose_pattern_inject those of the
    intents that fired rules add; the two refining modes go through `work`. A request without parts is its own part.
    """
    if mode == "direct":
        got = retrieve(requests.select("q", F.array(F.lit(0)).alias("place"), "text"))
        return got.filter(F.col("rank") <= k).select("q", "rank", "leaf", "score")
    if split is None:
        raise ValueError("this mode needs split")
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(1).alias("expected")))
    parts = requests.join(split(requests).select("q", "parts"), "q", "left")
    parts = parts.withColumn("parts", F.when(F.coalesce(F.size("parts"), F.lit(0)) > 0, F.col("parts").cast("array<struct<text:string,expected:int>>")).otherwise(whole))
    if mode == "decompose_pattern_inject":
        if inject is None:
            raise ValueError("this mode needs inject")
        texts = inject(F.transform("parts", lambda s: s["text"]), F.col("text"))
        parts = parts.withColumn("parts", F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(1).alias("expected"))))
    steps = parts.select("q", F.posexplode("parts").alias("pos", "s")).select("q", "pos", "s.text", "s.expected")
    if mode in CIRCLES:
        if refine is None:
            raise ValueError("this mode needs refine")
        return work(steps, retrieve, refine, mode, k).pool
    if mode not in ("decompose", "decompose_pattern_inject", "dependency_hinted_decompose"):
        raise ValueError(f"no mode {mode}")
    got = retrieve(steps.select("q", F.array(F.col("pos")).alias("place"), "text"))
    return union_pool(got.select("q", F.col("place").alias("sub"), (F.col("rank") - 1).alias("rank"), "leaf"), k, k)
