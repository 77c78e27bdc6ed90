import io
from contextlib import redirect_stdout

import pytest
from canopy.sources import run_store


def test_runs_are_kept_and_read_at_their_latest(spark, tmp_path):
    root = str(tmp_path / "runs")
    frame = spark.createDataFrame
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(run_store.load(spark, "goal", root)) == []
    run_store.save("goal", frame([("a", '{"g":1}', 7), ("b", '{"g":2}', 8)], "run string, body string, more int"), root)
    run_store.save("goal", frame([("a", '{"g":0}')], "run string, body string"), root)
    assert rows(run_store.load(spark, "goal", root)) == [("a", '{"g":0}'), ("b", '{"g":2}')]
    assert rows(run_store.load(spark, "goal", root, ["b", "nowhere"])) == [("b", '{"g":2}')]
    assert rows(run_store.load(spark, "goal", root, [])) == []

    plans = [("a", v, f'{{"v":{v}}}') for v in (10, 2, 1)] + [("b", 1, "{}")]
    run_store.save("plan", frame(plans, "run string, version long, body string"), root)
    run_store.save("plan", frame([("a", 2, "{}"), ("a", 2, '{"again":1}')], "run string, version long, body string"), root)
    assert rows(run_store.plan_versions(spark, root)) == [("a", [1, 2, 10]), ("b", [1])]
    assert ("a", 2, max("{}", '{"again":1}')) in rows(run_store.load(spark, "plan", root, ["a"]))

    run_store.save("artifact", frame([("a", "s1-artifact-1", None), ("a", "s1-artifact-2", "[]")], "run string, artifact string, body string"), root)
    assert run_store.load(spark, "artifact", root, ["a"]).filter("artifact = 's1-artifact-2'").first()["body"] == "[]"
    assert run_store.load(spark, "artifact", root).count() == 2

    events = frame([("a", 1, "x"), ("a", 1, "x")], "run string, seq long, body string")
    run_store.save("feedback", events, root)
    run_store.save("feedback", events, root)
    assert run_store.load(spark, "feedback", root).count() == 4
    with pytest.raises(ValueError):
        run_store.save("other", events, root)


def test_named_runs_read_their_folders_only(spark, tmp_path):
    root = str(tmp_path / "runs")
    run_store.save("state", spark.createDataFrame([(f"r{i}", "{}") for i in range(500)], "run string, body string"), root)
    out = io.StringIO()
    with redirect_stdout(out):
        run_store.load(spark, "state", root, ["r7"]).explain("formatted")
    assert "PartitionFilters: [isnotnull(bucket" in out.getvalue() or "PartitionFilters: [(bucket" in out.getvalue()
    assert run_store.load(spark, "state", root, ["r7"]).count() == 1
