"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeats, empty tables and odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canopy.llm import bpe, fingerprints, lm, nearest, quality, simhash, toxicity
from canopy.llm.lines import dedup_lines
from canopy.llm.packing import best_bounds, grid_length, pack, padding
from canopy.llm.queries import tokenizer_path
from canopy.llm.sharding import assign_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _row string, _id string, h int, tf int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, "x", "y", 1, 2) for i, t in zip(ids, texts)], SCHEMA)


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 6))) + str(rng.randrange(words) % 7) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "A a", "x " * 3000, "é" * 5000, "one two three four five six", "one two three four five six", "<|endoftext|> \x1c x\x00y", "b\n" * 2000]


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_is_the_librarys(spark, library):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice(["ab", " \n\t", "the in ing ", "'sdlm", "éñ日🙂", "-=_*#", "0123"]) for _ in range(rng.randint(1, 400))) for _ in range(60))]
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, texts), tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_round_trip_and_stream(spark):
    texts = [t for t in ODD if t]
    back = bpe.decode(bpe.encode(frame(spark, texts), tokenizer_path()), tokenizer_path(), "again")
    assert all(r["text"] == r["again"] for r in back.select("text", "again").collect())
    t = bpe.Transducer(bpe.load(tokenizer_path()), block=16)
    rng = random.Random(2)
    for alphabet in ("-=_*#.", "ab", "tion", "é"):
        data = "".join(rng.choice(alphabet) for _ in range(3000)).encode()
        assert list(t.stream([data[:1000], data[1000:]])) == t.merge(data)


def test_bpe_encodes_alike_in_parts_of_any_size(library):
    t = bpe.Transducer(bpe.load(tokenizer_path()))
    rng = random.Random(4)
    for _ in range(300):
        x = "".join(rng.choice(["ab", " \n\t", "the in ing ", "'sdlm", "éñ日🙂", "-=_*#", "0123", "<|endoftext|>", " ", "\u3000", "a" * rng.randint(1, 900)]) for _ in range(rng.randint(1, 60)))
        got = np.frombuffer(b"".join(t.encode(x, size=rng.choice([1, 3, 17, 100, 1 << 15]))), "<u4").tolist()
        assert got == library.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["word some other\n", "abcdefgh", "    "])
def test_bpe_memory_does_not_grow_with_the_text(unit):
    import tracemalloc

    t = bpe.Transducer(bpe.load(tokenizer_path()))
    peak = []
    tracemalloc.start()
    for k in (1, 1, 6):
        x = unit * (k * (1 << 19) // len(unit))
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert sum(map(len, t.encode(x))) > 0
        peak.append(tracemalloc.get_traced_memory()[1] - before)
    tracemalloc.stop()
    assert peak[2] < 1.5 * peak[1] + 1_000_000


def test_bpe_decoder_waits_for_characters(library):
    tokens = bpe.load(tokenizer_path())["tokens"]
    ids = [i for i, t in enumerate(tokens) if len(t) == 1]
    rng = random.Random(3)
    for _ in range(50):
        some = [rng.choice(ids) for _ in range(40)]
        d = bpe.Decoder(tokens)
        assert "".join(d.feed([i]) for i in some) + d.feed((), True) == library.decode(some, skip_special_tokens=False)


# ---------------------------------------------------------------- fingerprints


def winnow_by_hand(text, k=5, w=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]{1,8}", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    p, b = fingerprints.PRIME, fingerprints.BASE
    h = []
    for x in words:
        v = xxhash.xxh64_intdigest(x.encode(), 42)
        v = v - (1 << 64) if v >> 63 else v
        h.append(v % p)
    grams = [h[i : i + k] for i in range(max(len(h) - k + 1, 1))] if h else []
    values = []
    for g in grams:
        v = 0
        for x in g:
            v = (v * b + x) % p
        values.append(v)
    out = []
    for s in range(max(len(values) - w + 1, 1) if values else 0):
        win = values[s : s + w]
        i = max(j for j, v in enumerate(win) if v == min(win))
        if (win[i], s + i) not in out:
            out.append((win[i], s + i))
    return out


@pytest.mark.parametrize("k,w", [(5, 4), (1, 1), (3, 5), (8, 7)])
def test_winnowing(spark, k, w):
    rng = random.Random(4)
    texts = [*ODD, *(prose(rng, rng.randint(1, 60), 3) for _ in range(20))]
    for r in fingerprints.fingerprint(frame(spark, texts), k, w).collect():
        assert list(zip(r["hashes"], r["positions"])) == winnow_by_hand(texts[r["doc_id"]] or "", k, w)


def test_edited_pairs(spark):
    rng = random.Random(5)
    texts = [*ODD, *(prose(rng, rng.randint(1, 80)) for _ in range(40))]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(frame(spark, texts, ids)).collect()}
    assert len(got) == len(ids)

    def alike(a, b):
        a, b = {h for h, _ in winnow_by_hand(a)}, {h for h, _ in winnow_by_hand(b)}
        return len(a & b) / len(a | b) if a | b else 1.0

    for at, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        r = got[ids[i]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(alike(t, e)) and r["near_next"] == pytest.approx(alike(t, nxt))
    assert got[ids[8]]["fingerprint"] == got[ids[9]]["fingerprint"]


def test_edited_pairs_of_few_rows(spark):
    assert fingerprints.edited_pairs(frame(spark, [])).collect() == []
    one = fingerprints.edited_pairs(frame(spark, ["a b c d e f"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.edited_pairs(frame(spark, ["a", "a", None, "b"], [1, 1, None, None])).count() == 4


# ---------------------------------------------------------------- sharding


def test_sharding(spark):
    ids = [*range(2000), None, None, 7, 7]
    texts = [None if i == 3 else "é" * ((i or 0) % 5) for i in ids]
    rows = assign_shards(frame(spark, texts, ids)).collect()
    assert len(rows) == len(ids)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(16))
    assert max(map(len, by.values())) < 1.5 * len(ids) / 16
    assert 0.5 < sum(r["grown_shard"] == 16 for r in rows) / (len(ids) / 17) < 1.5
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in rows if r["doc_id"] is not None and r["doc_id"] != 7)
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows if r["doc_id"] not in (None, 7))
    again = {r["doc_id"]: r["shard"] for r in assign_shards(frame(spark, texts[:100], ids[:100]).repartition(7)).collect()}
    assert all(again[r["doc_id"]] == r["shard"] for r in rows if r["doc_id"] in again)
    assert assign_shards(frame(spark, [])).collect() == []


def test_shard_weights(spark):
    n = Counter(r["shard"] for r in assign_shards(frame(spark, ["x"] * 4000), [1.0, 3.0]).collect())
    assert 0.68 < n[1] / 4000 < 0.82
    with pytest.raises(ValueError):
        assign_shards(frame(spark, ["x"]), [1.0, 0.0])


# ---------------------------------------------------------------- lines


def test_line_dedup(spark):
    rng = random.Random(6)
    shared = [prose(rng, 12) for _ in range(5)]
    edge = "k" * 39 + "É"
    texts = []
    for i in range(40):
        lines = [prose(rng, 8) for _ in range(rng.randint(0, 3))] + rng.sample(shared, rng.randint(0, 3))
        if i < 5:
            lines += ["  " + edge + "\t", edge.upper().replace("É", "É")]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [None, "", "\n", shared[0], shared[0] + "\n" + shared[0]]
    strip, fold = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(fold)
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    got = {r["doc_id"]: r for r in dedup_lines(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
        assert (got[i]["text"], got[i]["_n_lines"], got[i]["_n_dropped"], got[i]["_row"]) == ("\n".join(kept), len(lines), len(lines) - len(kept), "x")
    assert dedup_lines(frame(spark, [])).collect() == []
    assert dedup_lines(frame(spark, ["a", "a", None], [None, None, None])).count() == 3


# ---------------------------------------------------------------- LM


def test_lm_base_and_gain(spark):
    rng = random.Random(7)
    lex = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    texts = [" ".join(rng.choice(lex[i % 2]) for _ in range(rng.randint(1, 120))) for i in range(300)] + [None, "", "UNSEEN Word\x0bb1"]
    docs = frame(spark, texts)
    keep = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    train = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    model, counts = lm.train(train, classes=8, known=100)
    got = {r["doc_id"]: r for r in lm.score(docs, model, counts).collect()}
    c = Counter(w for t, k in zip(texts, keep) if k for w in lm.words(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts) and {r["train_tokens"] for r in got.values()} == {n}
    for i, t in enumerate(texts):
        ws = lm.words(t)
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(ws), sum(c[w] > 0 for w in ws))
        assert got[i]["base_score"] == pytest.approx(base)
    held = [got[i] for i in range(300) if not keep[i]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert model.mass.sum() == pytest.approx(n + 0.1 * (v + model.classes))

    def kind(w):
        return model.type_of[model.vocabulary[w]] if w in model.vocabulary else lm.TYPES + zlib.crc32(w[-4:]) % lm.SUFFIXES

    nothing = lm.TYPES + lm.SUFFIXES
    for i in [*range(0, 300, 20), 300, 301, 302]:
        total, before = 0.0, [nothing, nothing]
        for w in lm.words(texts[i]):
            at = lm._rows(np.array([before[0]]), np.array([before[1]]), model.rows)
            z = np.log(model.mass / model.mass.sum()) + sum(model.weights[r[0]].astype(float) for r in at)
            own = model.class_of[kind(w)]
            total += (z[own] - np.log(np.exp(z).sum())) / np.log(10) + np.log10((c[w] + 0.1) / model.mass[own])
            before = [kind(w), before[0]]
        assert got[i]["score"] == pytest.approx(total, rel=1e-4)


def test_lm_tables_grow_and_rounds_take_each_text_once(spark):
    sizes = [sum(lm.feature_rows(n)) for n in (0, lm.FEW, 3 * lm.FEW, 12 * lm.FEW, 10**15)]
    assert sizes[0] == sizes[1] == sum(lm.ROWS) and sizes[2] == 2 * sizes[0] and sizes[3] == 4 * sizes[0] and sizes[4] == 1 << 20
    r = np.random.default_rng(0).integers(0, 1 << 20, 5000)
    order = lm._grouped(r, 1 << 20)
    assert sorted(order.tolist()) == list(range(5000)) and len(set(r.tolist())) == 1 + np.count_nonzero(np.diff(r[order]))
    texts = [f"a{i % 7} b{i % 7} c{i % 3}" for i in range(60)]
    model, _ = lm.train(frame(spark, texts).repartition(3), classes=4, known=100, rounds=3)
    tokens = sum(len(lm.words(t)) for t in texts)
    # every token meets one row of each feature; a row's count is the mean of the tasks that met it
    assert 0 < model.seen.sum() <= 3 * tokens and np.isfinite(model.weights).all()
    one, _ = lm.train(frame(spark, texts).coalesce(1), classes=4, known=100)
    assert one.seen.sum() == 3 * tokens


def test_lm_step_is_the_gradient():
    rng = np.random.default_rng(1)
    sizes = (8, 8, 16)
    model = lm.Model({}, np.ones(1), 1, 1, 4, np.zeros(1), np.zeros(1), mass=rng.random(4) + 0.1, rows=sizes)
    weights, seen = rng.normal(size=(32, 4)).astype(np.float32), rng.integers(0, 5, 32).astype(np.float32)
    rows, target = [rng.integers(a, b, 40) for a, b in ((0, 8), (8, 16), (16, 32))], rng.integers(0, 4, 40)
    z = sum(weights[r].astype(float) for r in rows) + np.log(model.mass / model.mass.sum())
    grad = np.exp(z) / np.exp(z).sum(1, keepdims=True) - np.eye(4)[target]
    total, times = np.zeros((32, 4)), np.zeros(32)
    for r in rows:
        np.add.at(total, r, grad)
        np.add.at(times, r, 1)
    want = weights - 2.0 * total / (seen + times + 16)[:, None]
    lm._update(model, weights, seen_now := seen.copy(), rows, target, 2.0)
    assert weights == pytest.approx(want, abs=1e-5) and (seen_now == seen + times).all()


def test_lm_of_nothing(spark):
    model, counts = lm.train(frame(spark, []), classes=4)
    assert lm.score(frame(spark, []), model, counts).collect() == []
    rows = lm.score(frame(spark, ["a b", None]), model, counts).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [(1, 0, 0), (3, 0, 0)] and all(np.isfinite(r["score"]) for r in rows)


# ---------------------------------------------------------------- nearest


def test_nearest_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64)).astype("float32")
    x[5] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 64), (9200, [float("nan")] * 64), (9300, [None] * 64), (9400, [float("inf")] + [1.0] * 63), (None, [1.0] * 64), (9500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index, q = nearest.build(df.repartition(3))
    got = defaultdict(list)
    for r in nearest.search(index, q, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = x.astype(float)
    hit = 0
    for i in range(0, 3000, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want = set(np.lexsort((np.arange(3000), d))[:10].tolist())
        hit += len(want & {v for v, _ in got[i]})
        assert all(s == pytest.approx(d[v], rel=1e-12) for v, s in got[i]) and [s for _, s in got[i]] == sorted(s for _, s in got[i])
    assert set(got) == set(range(0, 3000, 100)) and hit / 300 >= 0.97
    assert got[100][0] == (5, 0.0)


def test_nearest_recall_of_many_rows_with_few_reranked(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100_000, 32)).astype("float32")
    x[50_000:] += 6 * rng.normal(size=(50, 32)).astype("float32")[rng.integers(0, 50, 50_000)]  # half in clusters, in rows that stand together
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    index, q = nearest.build(df)
    got = defaultdict(set)
    for r in nearest.search(index, q, F.col("id") % 1000 == 0, at_once=40).collect():
        got[r["query_id"]].add(r["vec_id"])
    x, hit = x.astype(float), 0
    for i in range(0, 100_000, 1000):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & got[i])
    assert hit / 1000 >= 0.95


def test_nearest_takes_the_usual_length_and_any_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = []
    for parts in (1, 7):
        index, q = nearest.build(df.repartition(parts))
        found.append(sorted(map(tuple, nearest.search(index, q, F.col("id") % 100 == 0, rerank=20).collect())))
    assert found[0] == found[1] and {r[0] for r in found[0]} == {0, 100, 200, 300} and all(r[2] < 400 for r in found[0])


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    index, q = nearest.build(df)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.search(index, q, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    index, q = nearest.build(df.limit(0))
    assert nearest.search(index, q, F.lit(True)).collect() == []


# ---------------------------------------------------------------- classifiers


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, _y string")


def test_quality(spark):
    rng = random.Random(8)
    good = [prose(rng, rng.randint(30, 300)) for _ in range(200)]
    bad = [prose(rng, rng.randint(30, 300)).upper().replace(" ", "!! ") for _ in range(80)]
    texts = good + bad + ODD
    docs = frame(spark, texts)
    marked = labels(spark, [(i, int(i < 200), 0, "z") for i in range(280) if i % 4] + [(None, 1, 0, "z"), (5000, None, None, "z"), (0, 7, 7, "z")])
    model = quality.fit(docs, marked)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score_column(docs, model).alias("s")).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([got[i] >= 0.3 for i in range(0, 200, 4)]) > 0.95 and np.mean([got[i] < 0.3 for i in range(200, 280, 4)]) > 0.9
    plain = quality.fit(docs, marked.limit(0))
    assert docs.limit(0).select(quality.score_column(docs, model)).collect() == [] and plain["prior"] == 0.5


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["moron", "idiot", "scum"]
    texts = []
    for i in range(400):
        words = prose(rng, rng.randint(20, 200)).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", ",", "&&&"]))
        texts.append(" ".join(words))
    texts += ODD
    docs = frame(spark, texts)
    marked = labels(spark, [(i, 1, int(i % 4 == 0), "z") for i in range(300)])
    model = toxicity.fit(docs, marked)
    rows = {r["doc_id"]: r["t"] for r in docs.select("doc_id", toxicity.scored(docs, model).alias("t")).collect()}
    assert np.mean([rows[i]["score"] >= 0.3 for i in range(300, 400, 4)]) > 0.95
    assert np.mean([rows[i]["score"] < 0.3 for i in range(300, 412) if i % 4 or i >= 400]) > 0.95
    assert all(e % 4 == 0 for i in range(300, 400, 4) for e in rows[i]["evidence"][:1])
    assert "prior" in toxicity.fit(docs, marked.filter("toxic = 0"))


def test_toxicity_finds_a_rarer_language(spark):
    rng = random.Random(13)
    texts = []
    for i in range(780):
        words = prose(rng, rng.randint(20, 60)).split()
        if i % 2 == 0:
            words[3:3] = ["estupido", "basura"] if i % 32 == 0 else ["moron", "scum"]
        texts.append(" ".join(words))
    docs = frame(spark, texts)
    model = toxicity.fit(docs, labels(spark, [(i, 1, int(i % 2 == 0), "z") for i in range(420)]))  # 7 examples of the rarer language
    score = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.scored(docs, model)["score"].alias("s")).collect()}
    assert all(score[i] >= 0.3 for i in range(608, 780, 32)) and np.mean([score[i] < 0.3 for i in range(600, 780) if i % 2]) > 0.95


def test_near_copies_of_the_same_label_alone_leave_the_examples():
    rng = random.Random(12)
    some = [[f"v{rng.randrange(10**6)}" for _ in range(100)] for _ in range(40)]
    ex = [(i, " ".join(w), 1) for i, w in enumerate(some)]
    ex += [(100 + i, " ".join(w), 0) for i, w in enumerate(some)]  # the same texts, of the other label
    ex += [(200 + i, " ".join(w[:60] + [f"n{j}" for j in range(40)]), 1) for i, w in enumerate(some)]  # shared passages
    copies = [(300 + i, " ".join(w[:-5]), 1) for i, w in enumerate(some)]
    kept = {e[0] for e in toxicity.unlike(ex + copies)}
    assert {i for i in kept if i < 200} == {*range(40), *range(100, 140)} and not kept & set(range(300, 340))
    assert {i for i in kept if i >= 200} == set(range(200, 240))


def test_block_max_is_exact():
    rng = random.Random(10)
    lex = [f"w{i}" for i in range(80)]
    ex = [(i, " ".join(rng.choices(lex, weights=range(1, 81), k=rng.randint(1, 40))), i % 2) for i in range(300)]
    voc = {w.encode(): i for i, w in enumerate(lex)}
    df = np.array([sum(w in t.split() for _, t, _ in ex) for w in lex], float)
    index = toxicity.Index(ex, df, 300, voc, block=16)
    dense = np.zeros((300, 80))
    for k, (_, t, _) in enumerate(ex):
        ids, w = index.vector(t)
        dense[k, ids] = w
    for _ in range(60):
        t = " ".join(rng.choices(lex, k=rng.randint(1, 30)))
        q = np.zeros(80)
        ids, w = index.vector(t)
        q[ids] = w
        best, cos = index.nearest(t, 7, first=1)
        assert cos == pytest.approx(np.sort(dense @ q)[::-1][: len(cos)])


# ---------------------------------------------------------------- SimHash


def fp_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, limit):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_documents(spark):
    rng = random.Random(11)
    base = [prose(rng, 200) for _ in range(6)]
    texts = [*ODD]
    for b in base:
        words = b.split()
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [fp_by_hand(t) for t in texts]
    assert all(got[i]["_fp"] % (1 << 64) == fps[i] for i in range(len(texts)))
    assert [got[i]["component_id"] for i in range(len(texts))] == roots(fps, 3)
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    none = simhash.near_duplicates(frame(spark, ["a", None, "a"], [None, None, 4])).collect()
    assert sorted(str(r["component_id"]) for r in none) == ["4", "4", "None"]


@pytest.mark.parametrize("segments,limit,most", [(16, 3, 20_000), (4, 3, 20_000), (16, 3, 50), (7, 2, 30)])
def test_links_join_what_brute_force_joins(spark, segments, limit, most):
    rng = random.Random(12)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(15):
            fps.add(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    for _ in range(150):  # a dense group that shares all keys but a few
        fps.add(centres[0] ^ sum({1 << rng.randrange(8) for _ in range(4)}))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "_fp long")
    edges = simhash.links(df, limit, segments, most=most)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= limit for r in edges.collect())
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = [root.get(s, s) for s in signed]
    want = roots(fps, limit)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


# ---------------------------------------------------------------- packing


def test_bounds_are_optimal():
    from itertools import combinations

    rng = random.Random(13)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 9))))
        counts = np.array([rng.randint(1, 20) for _ in lengths])
        for k in (1, 2, 3):
            bounds = best_bounds(lengths, counts, k)
            top = lengths[-1]
            best = min(padding(lengths, counts, sorted({*c, top})) for c in combinations(lengths.tolist(), min(k, len(lengths)) - 1 or 0)) if k > 1 else padding(lengths, counts, [top])
            assert len(bounds) <= k and padding(lengths, counts, bounds) == best


def test_packing(spark):
    rng = random.Random(14)
    n = [rng.choice([0, 1, 3, 50, 51, 900, 5000, 100_001]) for _ in range(500)]
    df = spark.createDataFrame([(i, x, "b") for i, x in enumerate(n)] + [(None, None, "b"), (3, 7, "b")], "doc_id long, x long, batch string")
    rows = pack(df, F.col("x"), buckets=4, budget=2000).collect()
    assert len(rows) == 502
    groups = defaultdict(list)
    longest = defaultdict(int)
    for r in rows:
        longest[r["bucket"]] = max(longest[r["bucket"]], r["n_tokens"])
    for r in rows:
        assert r["bucket_len"] == longest[r["bucket"]]
        groups[r["bucket"], r["batch"]].append(r)
    for (_, _), g in groups.items():
        assert len(g) == 1 or len(g) * g[0]["bucket_len"] <= 2000
        assert sorted(r["place"] for r in g) == list(range(len(g)))
    for b in {r["bucket"] for r in rows}:
        assert sorted({k[1] for k in groups if k[0] == b}) == list(range(len({k[1] for k in groups if k[0] == b})))
    assert pack(df.limit(0), F.col("x")).collect() == []
    grid = [r[0] for r in spark.range(1, 20_000, 7).select(grid_length(F.col("id"))).collect()]
    assert all(i <= g <= i * 1.001 for i, g in zip(range(1, 20_000, 7), grid))


def test_packing_of_long_rows_is_near_the_optimum(spark):
    rng = random.Random(15)
    n = [int(rng.lognormvariate(8, 1.5)) for _ in range(3000)]
    rows = pack(spark.createDataFrame([(i, x) for i, x in enumerate(n)], "doc_id long, x long"), F.col("x"), buckets=6).collect()
    lengths, counts = np.unique(np.array(n), return_counts=True)
    best = padding(lengths, counts, best_bounds(lengths, counts, 6))
    got = sum(r["bucket_len"] - r["n_tokens"] for r in rows)
    assert best <= got <= best + sum(x for x in n if x > 4096) / 2048
