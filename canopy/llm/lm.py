"""Hashed maximum-entropy language model with a class-factored softmax, trained by distributed gradient updates.

p(w | h) = p(class(w) | h) * p(w | class(w)). The first factor is a softmax over classes whose logits are sums of
hashed weight rows for the previous word, the word before it (skip) and both (n-gram); the second is the word's
share of its class in the corpus, smoothed by 0.1 for each known word and for one unknown word a class.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import per_process, ship, small_batches, stored

ship(__name__)

SMOOTH = 0.1
#: Rows of the weight table for each feature (previous word, skip, both) up to FEW tokens; see `feature_rows`.
ROWS = (16_384, 16_384, 32_768)
FEW = 1 << 24
SUFFIXES = 8192  # classes of the rarer words go by a hash of their last four bytes
TYPES = 24_576  # words with a context signature of their own
CONTEXTS = 32


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end, which is empty as no word is."""
    return [*(text or "").encode().lower().split(), b""]


@dataclass
class Model:
    vocabulary: dict[bytes, int]  # the most frequent words, at most `known`
    counts: np.ndarray
    n: int
    v: int
    classes: int
    contexts: np.ndarray  # of each type (own or suffix): its number among the context words, CONTEXTS - 1 if none
    type_of: np.ndarray  # of each vocabulary number
    class_of: np.ndarray = field(default=None)  # of each type
    mass: np.ndarray = field(default=None)  # of each class, with 0.1 a word
    rows: tuple[int, ...] = ROWS
    weights: np.ndarray = field(default=None)  # [sum of rows, classes]
    seen: np.ndarray = field(default=None)  # of each row: how often a task has met it so far, on average
    version: str = ""


class _Codes(dict):
    """Words to vocabulary numbers; others to their suffix's number beyond the vocabulary, without being kept."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__(vocabulary)
        self.known = len(vocabulary)

    def __missing__(self, word: bytes) -> int:
        return self.known + zlib.crc32(word[-4:]) % SUFFIXES


def _types(m: Model, codes: np.ndarray) -> np.ndarray:
    return np.where(codes < len(m.type_of), m.type_of[np.minimum(codes, len(m.type_of) - 1)], codes - len(m.type_of) + TYPES)


def _batch(codes_of: _Codes, m: Model, texts: list[str | None]):
    """(words by text, codes, types, of the previous word, of the one before) of all texts in a row; TYPES + SUFFIXES: none."""
    split = [words(t) for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.fromiter(map(codes_of.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
    types = _types(m, codes)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    none = TYPES + SUFFIXES
    one = np.concatenate([[none], types[:-1]])
    two = np.concatenate([[none, none], types[:-2]])[: len(types)]
    one[first] = none
    two[first] = none
    second = first[size > 1] + 1
    two[second] = none
    return split, size, codes, types, one, two


def feature_rows(tokens: int, most: int = 1 << 20) -> tuple[int, ...]:
    """Rows of each feature: twice as many for each fourfold of tokens above FEW, as distinct histories grow by about
    the square root. `most` bounds their sum, and so what a worker holds and a broadcast sends (128 bytes a row of 32 classes)."""
    times = 0
    while FEW * 4 ** (times + 0.5) < tokens and sum(ROWS) << (times + 1) <= most:
        times += 1
    return tuple(r << times for r in ROWS)


def _grouped(r: np.ndarray, rows: int) -> np.ndarray:
    """An order that puts equal rows together; 16 bits at a time are sorted by radix."""
    order = np.argsort(r.astype(np.uint16), kind="stable")
    return order if rows <= 1 << 16 else order[np.argsort((r >> 16)[order].astype(np.uint16), kind="stable")]


def _rows(one: np.ndarray, two: np.ndarray, sizes: tuple[int, ...] = ROWS) -> list[np.ndarray]:
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(32)) ^ x

    a, b = mix(one), mix(two)
    pair = mix(one.astype(np.int64) * 65_537 + two)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return [(h % np.uint64(r)).astype(np.int64) + s for h, r, s in zip((a, b, pair), sizes, starts)]


def _logits(m: Model, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sums of the weight rows over the classes' shares, shifted so that the largest of each row is 0."""
    z = weights.take(rows[0], axis=0)
    z += weights.take(rows[1], axis=0)
    z += weights.take(rows[2], axis=0)
    z += np.log(m.mass / m.mass.sum()).astype(np.float32)
    z -= z.max(1, keepdims=True)
    return z


def _update(m: Model, weights: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], target: np.ndarray, rate: float) -> None:
    """One gradient step on a batch; a row's step shrinks with how often it has been seen.

    Rows met once, as most pairs are, need no sum.
    """
    grad = _logits(m, weights, rows)
    np.exp(grad, out=grad)
    grad /= grad.sum(1, keepdims=True)
    grad[np.arange(len(target)), target] -= 1
    for r in rows:
        order = _grouped(r, len(weights))
        own = r[order]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        own, n = own[at], np.diff(np.concatenate([at, [len(order)]]))
        total = grad.take(order[at], axis=0)
        more = n > 1
        if more.any():
            ends = np.cumsum(n[more])
            total[more] = np.add.reduceat(grad.take(order[np.repeat(more, n)], axis=0), ends - n[more], axis=0)
        seen[own] += n
        total *= (rate / (seen[own] + 16))[:, None]
        weights[own] = weights.take(own, axis=0) - total


def count_words(docs: DataFrame, text_col: str, most: int = 400_000) -> DataFrame:
    """(word, n) over all docs: counted in each task, `most` words at a time, then summed."""

    def run(batches):
        import pyarrow as pa

        def out(c: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
                if len(counts) > most:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bin() -> Column:
    return F.floor(F.log2("n") * 16)


def signatures(docs: DataFrame, m: Model, shared, text_col: str) -> np.ndarray:
    """How often each context word is one of the two words before each type, over all docs."""

    def run(batches):
        import pyarrow as pa

        m = Model(**shared.value)
        codes_of = _Codes(m.vocabulary)
        cells = np.zeros((TYPES + SUFFIXES) * CONTEXTS, np.int64)
        contexts = np.concatenate([m.contexts, [CONTEXTS - 1]])
        for batch in batches:
            if batch.num_rows:
                _, _, _, types, one, two = _batch(codes_of, m, batch.column(0).to_pylist())
                for before in (one, two):
                    cells += np.bincount(types * CONTEXTS + contexts[before], minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    got = docs.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").cast("double").alias("n")).toPandas()  # at most one row a cell
    out = np.zeros((TYPES + SUFFIXES) * CONTEXTS)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out.reshape(-1, CONTEXTS)


def cluster(sign: np.ndarray, classes: int, rounds: int = 25, seed: int = 0) -> np.ndarray:
    """Class of each type by weighted k-means on square roots of its context shares."""
    size = sign.sum(1)
    x = np.sqrt((sign + sign.sum(0) / max(sign.sum(), 1) * 4) / (size[:, None] + 4))
    rng = np.random.default_rng(seed)
    p = np.sqrt(size) + 1e-9
    c = x[rng.choice(len(x), classes, replace=False, p=p / p.sum())]
    for _ in range(rounds):
        a = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
        for k in range(classes):
            w = size[a == k]
            if w.sum() > 0:
                c[k] = np.average(x[a == k], axis=0, weights=w)
    return a.astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", classes: int = 32, known: int = 262_144, rounds: int = 1, rate: float = 6.0, batch: int = 4096) -> tuple[Model, DataFrame]:
    """The model of all docs, and the table (word, n) of all their words.

    known: words that each worker holds, with their counts; scoring gets the counts of the rest by a join. A hash of the
    text deals the docs into `rounds` parts, one a round, so each token is trained on once. In a round every task makes
    gradient steps over its tokens from the weights of the round before, and the rows are averaged by how
    often each task has seen them; the sums go through the square root of the number of tasks at a time.
    Rows that repeat an id are texts of their own; other columns play no part. Docs without rows give a model that scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = stored(count_words(docs, text_col), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    bins = sorted(((r["b"], r["k"]) for r in counts.groupBy(_bin().alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    low, have = None, 0
    for b, k in bins:
        if have + k > known:
            break
        low, have = b, have + k
    top = counts.filter(_bin() >= low).toPandas() if low is not None else counts.limit(0).toPandas()
    top = top.sort_values(["n", "word"], ascending=[False, True])
    names = [w.encode() for w in top["word"]]
    vocabulary = {w: i for i, w in enumerate(names)}
    type_of = np.array([i if i < TYPES else TYPES + zlib.crc32(w[-4:]) % SUFFIXES for i, w in enumerate(names)], np.int64) if names else np.zeros(1, np.int64)
    contexts = np.full(TYPES + SUFFIXES, CONTEXTS - 1)
    contexts[: min(CONTEXTS - 1, TYPES)] = np.arange(CONTEXTS - 1)
    m = Model(vocabulary, top["n"].to_numpy(np.int64), int(total["n"] or 0), int(total["v"] or 0), classes, contexts, type_of)
    m.class_of = cluster(signatures(docs, m, spark.sparkContext.broadcast(vars(m)), text_col), classes)
    m.mass = _masses(counts, m)
    m.rows = feature_rows(m.n)
    m.weights, m.seen = np.zeros((sum(m.rows), classes), np.float32), np.zeros(sum(m.rows), np.float32)
    part = F.pmod(F.xxhash64(F.col(text_col)), F.lit(rounds))
    for r in range(rounds):
        m.weights, m.seen = _round(docs.filter(part == r), m, text_col, rate, batch)
    m.version = hashlib.sha256(m.weights.tobytes() + m.counts.tobytes()).hexdigest()
    return m, counts


def _masses(counts: DataFrame, m: Model) -> np.ndarray:
    shared = counts.sparkSession.sparkContext.broadcast(vars(m))

    def run(batches):
        import pyarrow as pa

        m = Model(**shared.value)
        codes_of = _Codes(m.vocabulary)
        sums = np.zeros(m.classes)
        for b in batches:
            if b.num_rows:
                codes = np.fromiter((codes_of[w.encode()] for w in b.column("word").to_pylist()), np.int64, b.num_rows)
                sums += np.bincount(m.class_of[_types(m, codes)], np.asarray(b.column("n")) + SMOOTH, m.classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.classes)), pa.array(sums)], names=["c", "s"])

    mass = np.full(m.classes, SMOOTH)
    for r in counts.mapInArrow(run, "c long, s double").groupBy("c").agg(F.sum("s").alias("s")).collect():
        mass[r["c"]] += r["s"]
    return mass


def _round(docs: DataFrame, m: Model, text_col: str, rate: float, batch: int, piece: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Weights and counts of the rows after one pass over docs. What a task sends is a row's move in 16 bits and its count."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(m))

    def run(batches):
        import pyarrow as pa

        m = Model(**shared.value)
        codes_of = _Codes(m.vocabulary)
        weights, seen = m.weights.copy(), m.seen.copy()
        for b in batches:
            if b.num_rows:
                _, _, _, types, one, two = _batch(codes_of, m, b.column(0).to_pylist())
                target, rows = m.class_of[types], _rows(one, two, m.rows)
                for k in range(0, len(target), batch):
                    _update(m, weights, seen, [r[k : k + batch] for r in rows], target[k : k + batch], rate)
        seen -= m.seen
        keys, n, w = [], [], []
        for k in range(0, len(seen), piece):
            if seen[k : k + piece].any():
                keys.append(k)
                n.append(seen[k : k + piece].tobytes())
                w.append((weights[k : k + piece] - m.weights[k : k + piece]).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([1] * len(keys), pa.int64()), pa.array(n, pa.binary()), pa.array(w, pa.binary())], names=["at", "k", "n", "w"])

    def mean(key, pdf):
        import pandas as pd

        total, moved = 0.0, 0.0
        for n, w in zip(pdf["n"], pdf["w"]):
            n = np.frombuffer(n, np.float32).astype(np.float64)
            total = total + n
            moved = moved + n[:, None] * np.frombuffer(w, np.float16).reshape(len(n), -1)
        moved = moved / np.maximum(total, 1)[:, None]
        return pd.DataFrame({"at": [key[0]], "k": [pdf["k"].sum()], "n": [total.astype(np.float32).tobytes()], "w": [moved.astype(np.float16).tobytes()]})

    kind = "at long, k long, n binary, w binary"
    tasks = max(1, docs.rdd.getNumPartitions())
    moved = docs.select(text_col).mapInArrow(run, kind).withColumn("_g", F.spark_partition_id() % max(1, round(tasks**0.5)))
    part = moved.groupBy("at", "_g").applyInPandas(mean, kind).groupBy("at").applyInPandas(mean, kind)
    weights, seen = m.weights.copy(), m.seen.copy()
    for r in part.collect():  # the weight table
        n = np.frombuffer(r["n"], np.float32)
        weights[r["at"] : r["at"] + len(n)] += np.frombuffer(r["w"], np.float16).reshape(len(n), -1)
        seen[r["at"] : r["at"] + len(n)] += n / r["k"]
    return weights, seen


def score(docs: DataFrame, m: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row; null texts have the end alone.

    Words that workers do not hold are counted by text and meet their counts in a join, so all counts are exact.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vars(m))

    def run(batches):
        import pyarrow as pa

        m = Model(**shared.value)
        codes_of = per_process(("lm", m.version), lambda: _Codes(m.vocabulary))
        known = len(m.vocabulary)
        own = np.log10(np.concatenate([m.counts, [1]]) + SMOOTH)
        scale = np.log10(m.mass)
        for b in batches:
            if not b.num_rows:
                continue
            split, size, codes, types, one, two = _batch(codes_of, m, b.column("t").to_pylist())
            target, rows = m.class_of[types], _rows(one, two, m.rows)
            got = np.empty(len(codes))
            for k in range(0, len(codes), 8192):
                z = _logits(m, m.weights, [r[k : k + 8192] for r in rows])
                aim = z[np.arange(len(z)), target[k : k + 8192]]
                got[k : k + 8192] = (aim - np.log(np.exp(z, out=z).sum(1))) / np.log(10)
            got -= scale[target]
            top = codes < known
            base = np.where(top, own[np.minimum(codes, len(own) - 1)], 0.0)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            ids = b.column("_row").to_pylist()
            rest_row, rest_word, rest_n = [], [], []
            rare = np.flatnonzero(~top)
            of = np.searchsorted(first, rare, "right") - 1
            lists: dict[int, list[bytes]] = {}
            for i, d in zip((rare - first[of]).tolist(), of.tolist()):
                lists.setdefault(d, []).append(split[d][i])
            for d, ws in lists.items():
                for w, n in Counter(ws).items():
                    rest_row.append(ids[d])
                    rest_word.append(w)
                    rest_n.append(n)
            k = len(rest_row)
            # A text's own row has a word that no text has, as words hold no blank, and so meets no count.
            word = pa.array([*(b" %d" % i for i in ids), *rest_word], pa.binary()).cast(pa.string())
            nulls = [None] * k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids, *rest_row]),
                    pa.array([*b.column("_id").to_pylist(), *nulls], b.column("_id").type),
                    word,
                    pa.array([*([0] * len(ids)), *rest_n], pa.int64()),
                    pa.array([*size.tolist(), *nulls], pa.int64()),
                    pa.array([*np.add.reduceat(top.astype(np.int64), first).tolist(), *nulls], pa.int64()),
                    pa.array([*np.add.reduceat(base, first).tolist(), *nulls], pa.float64()),
                    pa.array([*np.add.reduceat(got, first).tolist(), *nulls], pa.float64()),
                ],
                names=["_row", "_id", "word", "tf", "n_tokens", "top", "own", "model"],
            )

    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("t"))
    flat = base.mapInArrow(run, "_row long, _id long, word string, tf long, n_tokens long, top long, own double, model double")
    least = int(m.counts[-1]) if len(m.counts) else 1 << 62
    rare = counts.filter(F.col("n") <= least)  # what workers hold has larger counts, or ties that join no row
    met = flat.join(rare, "word", "left")
    logs = F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).otherwise(0.0))
    out = met.groupBy("_row").agg(
        F.max("_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("top") + F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("own") + logs).alias("_own"),
        F.max("model").alias("_model"),
    )
    scale = float(np.log10(m.n + SMOOTH * (m.v + 1)))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), (F.col("_own") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("_own") + F.col("_model")).alias("score"))
