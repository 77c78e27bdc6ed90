"""The pipeline's stages, each on its own input, and the queries that SQL can express."""

import random
import tracemalloc

import duckdb
import numpy as np

import corpus_pipeline as cp
from canopy.llm import toxicity
from canopy.llm.base import stored
from canopy.llm.jaccard import apart, bitmap, can_reach, likeness, near_copies, shingles
from canopy.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)  # as run() and the driver do
        assert out.columns == columns, name
        rows = out.count()
        assert 0 < rows <= docs.count()
        docs = out
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string"
    rows = [(4, "a b c d", "en", "s", 7, "q"), (2, "a b c d", "en", "s", 7, "q"), (2, "a b c d", "en", "s", 7, "q"), (9, "other words here now", "en", "s", 20, "q"), (None, "x y", None, None, None, None), (None, "x y", None, None, None, None)]
    got = cp.near_duplicate_stage(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 2, 9]


def test_near_duplicate_stage_finds_copies_of_likeness_080_to_095(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows, copies = [], {}
    for g in range(60):
        base = [rng.choice(words) for _ in range(300)]
        rows.append((2 * g, " ".join(base)))
        changed = list(base)
        for i in rng.sample(range(0, 296, 6), 2 + g % 6):
            changed[i] = "x"
        rows.append((2 * g + 1, " ".join(changed)))
        s = likeness(shingles(rows[-2][1]), shingles(rows[-1][1]))
        copies[2 * g + 1] = s
    got = {r["doc_id"] for r in cp.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert sum(0.8 <= s <= 0.95 for s in copies.values()) == 50
    assert got == {2 * g for g in range(60)} | {i for i, s in copies.items() if s < 0.8}


def test_bitmaps_leave_no_pair_out(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (3, 40, 60, 63, 66, 250, 6000)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(w[: rng.randint(int(0.9 * len(w)), len(w))]))
    sets = [shingles(t) for t in texts]
    got = [bitmap(t, 5) for t in texts]
    root = np.arange(len(texts))
    root[12:18] = 12
    a, b = can_reach(np.array([n for n, _ in got]), root, [x for _, x in got], 0.8)
    found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    want = {(i, j) for j in range(len(texts)) for i in range(j) if root[i] != root[j] and likeness(sets[i], sets[j]) >= 0.8}
    assert want and want <= found and len(found) < 3 * len(want)
    members = spark.createDataFrame([(k, i, int(root[i])) for i in range(len(texts)) for k in (1, 2)], "key long, node long, root long")
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for most in (8192, 20):
        assert {tuple(r) for r in apart(members, frame, 5, 0.8, most).collect()} == found


def test_near_copies_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    sets, ids = [shingles(t) for t in texts], [min(i) for i in texts.values()]
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if 0.8 * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j])) and likeness(sets[i], sets[j]) >= 0.8:
                root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    want = {d: least[top(i)] for i, g in enumerate(texts.values()) for d in g}
    assert {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()} == want


def test_toxicity_and_quality_stages_drop_what_is_labelled_and_keep_the_clean(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for stage, bad, least in ((cp.toxicity_stage, lambda r: r["toxic"] == 1, 0.6), (cp.quality_stage, lambda r: r["quality"] == 0, 0.6)):
        kept = {r["doc_id"] for r in stage(spark, docs, folder).select("doc_id").collect()}
        dropped = [i not in kept for i, r in labels.items() if bad(r)]
        clean = [i in kept for i, r in labels.items() if r["toxic"] == 0 and r["quality"] == 1]
        assert sum(dropped) / len(dropped) >= least and sum(clean) / len(clean) >= 0.97, stage


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int"
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", None, None, 0, 1), (1, "x" * 50_000, "en", "s", 5, 1)], schema)
    for name, stage in cp.STAGES:
        assert stage(spark, odd, SF).count() <= 3, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def most_mb(run):
    """MB that run() allocates at most beyond what was there."""
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_toxicity_stage_holds_few_bytes_a_word():
    rng = random.Random(11)
    names = [f"word{i}" for i in range(5000)]
    examples = [(i, " ".join(rng.choices(names, k=1000)), i % 2) for i in range(300)]
    kept = []
    assert most_mb(lambda: kept.extend(toxicity.unlike(examples))) < 20  # 300,000 runs
    assert kept == examples
    index = toxicity.Index(examples[:10], None, 10, {b"word1": 0, b"word2": 1})
    text = " ".join(t for _, t, _ in examples) * 2
    assert most_mb(lambda: index.vector(text)) < 4 * len(text) / 1e6  # text of 5 MB, 600,000 words


def test_toxicity_words_in_parts_and_near_copies_as_before():
    rng = random.Random(12)
    text = "".join(rng.choice(["ab", "É", " ", "-", "x9", "\n", "\u3000"]) for _ in range(3000))
    for part in (1, 2, 7, 100, 1 << 20):
        assert list(toxicity.each_word(text, part)) == toxicity.words(text)
    assert list(toxicity.each_word(None)) == []
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(8)]
    examples = [(0, "", 0), (1, "", 0), (2, "", 1)]
    for i in range(3, 120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = "changed"
        examples.append((i, " ".join(w), rng.randrange(2)))
    want = []
    for e in examples:
        if not any(k[2] == e[2] and likeness(shingles(k[1]), shingles(e[1])) >= 0.8 for k in want):
            want.append(e)
    assert toxicity.unlike(examples) == want
    assert toxicity.unlike([]) == []
