"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fit_isotonic, from_fields, labelled_sample, per_process, ship, small_batches

ship(__name__)

#: Bytes to bytes: A-Z to a-z, what is neither a letter nor a digit of ASCII nor part of a longer character to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def each_word(text: str | None, part: int = 1 << 20) -> Iterator[bytes]:
    """The words one after the other; those of a part of the text at a time exist at once."""
    raw, at = (text or "").encode().translate(FOLD), 0
    while at < len(raw):
        cut = raw.find(b" ", at + part)
        cut = len(raw) if cut < 0 else cut
        yield from raw[at:cut].split()
        at = cut


def terms(word: bytes) -> tuple[bytes, ...]:
    """The word, and the beginnings of 4 and 5 characters of a longer one, marked: stems that take many endings."""
    s = word.decode("utf-8", "replace")
    return (word, *(b"^" + s[:n].encode() for n in (4, 5) if len(s) > n))


class _Codes(dict):
    """Words to the vocabulary numbers of their terms; emptied when full, and without words of more than 64 bytes."""

    def __init__(self, vocabulary: dict[bytes, int], most: int = 1 << 18):
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        got = tuple(i for t in terms(word) if (i := self.vocabulary.get(t)) is not None)
        if len(word) <= 64:
            self[word] = got
        return got


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, last), one range after the other."""
    size = last - first
    total = int(size.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)


def vote(labels: np.ndarray, cosine: np.ndarray) -> float:
    """Share of label 1 among the nearest, each weighted by cos^2/d, d its distance 1 - cos; -0.1 if none is near at all."""
    if not len(cosine) or cosine[0] <= 0:
        return -0.1
    w = np.maximum(cosine, 0) ** 2 / np.maximum(1 - cosine, 0.02)
    return float((w * labels).sum() / w.sum())


class Index:
    """Unit TF-IDF vectors of the examples by term, cut into blocks of examples that keep their largest weight.

    Weights are (1 + ln tf) * ln((1 + N) / (1 + df)) over the terms of the examples; others have no weight.
    """

    def __init__(self, examples: list[tuple[int, str, int]], df: np.ndarray | None, n_docs: int, vocabulary: dict[bytes, int] | None = None, block: int = 64):
        # Equal labels stand together, so that a block's largest weights are those of like texts.
        self.ids = np.array([i for i, _, _ in examples], np.int64)
        self.labels = np.array([y for _, _, y in examples], float)
        self.vocabulary = vocabulary if vocabulary is not None else vocabulary_of(examples)
        self.codes = _Codes(self.vocabulary)
        self.idf = np.log((1 + n_docs) / (1 + (np.zeros(len(self.vocabulary)) if df is None else df)))
        t, d, w = [], [], []
        for k, (_, text, _) in enumerate(examples):
            ids, weights = self.vector(text)
            t.append(ids)
            d.append(np.full(len(ids), k))
            w.append(weights)
        t, d, w = (np.concatenate(x) if x else np.empty(0) for x in (t, d, w))
        order = np.lexsort((d, t))
        t, self.doc, self.weight = t[order].astype(np.int64), d[order].astype(np.int64), w[order].astype(float)
        b = self.doc // block
        self.blocks = int(len(examples) + block - 1) // block
        new = np.flatnonzero(np.concatenate([[True], (np.diff(t) != 0) | (np.diff(b) != 0)])) if len(t) else np.empty(0, np.int64)
        self.start, self.end = new, np.concatenate([new[1:], [len(t)]]).astype(np.int64)
        self.block, self.most = b[new], (np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0))
        self.at = np.searchsorted(t[new] if len(new) else np.empty(0), np.arange(len(self.vocabulary) + 1))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[int, int] = {}
        for got in filter(None, map(self.codes.__getitem__, each_word(text))):
            for i in got:
                counts[i] = counts.get(i, 0) + 1
        if not counts:
            return np.empty(0, np.int64), np.empty(0)
        ids, n = np.fromiter(counts.keys(), np.int64), np.fromiter(counts.values(), np.int64)
        w = (1 + np.log(n)) * self.idf[ids]
        norm = np.sqrt((w * w).sum())
        return (ids, w / norm) if norm > 0 else (np.empty(0, np.int64), np.empty(0))

    def nearest(self, text: str | None, k: int, first: int = 4, leave: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0 and the cosines, ties to the earlier example: exact.

        A block's bound is the sum of its terms' largest weights. The blocks of the largest bounds are scored; of the
        others only those whose bound reaches the k-th best score so far. leave: an example that takes no part.
        """
        n = len(self.ids)
        ids, q = self.vector(text)
        scores = np.zeros(n)
        if len(ids):
            e = _ranges(self.at[ids], self.at[ids + 1])
            qe = np.repeat(q, self.at[ids + 1] - self.at[ids])
            bound = np.bincount(self.block[e], qe * self.most[e], self.blocks)
            done = np.zeros(self.blocks, bool)
            turn = np.zeros(self.blocks, bool)
            turn[np.argsort(-bound, kind="stable")[:first]] = True
            for _ in range(2):
                pick = turn[self.block[e]]
                s, t = self.start[e[pick]], self.end[e[pick]]
                p = _ranges(s, t)
                scores += np.bincount(self.doc[p], np.repeat(qe[pick], t - s) * self.weight[p], n)
                done |= turn
                if leave is not None:
                    scores[leave] = -1
                kth = np.partition(scores, n - min(k, n))[n - min(k, n)]
                turn = ~done & (bound >= kth - 1e-9) & (bound > 0)
                if not turn.any():
                    break
        if leave is not None:
            scores[leave] = -1
        k = min(k, n)
        kth = np.partition(scores, n - k)[n - k]
        best = np.flatnonzero(scores >= kth) if kth > 0 else np.flatnonzero(scores > 0)
        best = best[np.lexsort((best, -scores[best]))][:k]
        return best, scores[best]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        return vote(self.labels[best], cosine)


def _runs(text: str, n: int) -> np.ndarray:
    """Hashes of the text's runs of n words, rising, each once."""
    import xxhash

    got = words(text)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(got[i : i + n])) for i in range(max(len(got) - n + 1, 1))), np.uint64))


def unlike(examples: list[tuple[int, str, int]], n: int = 5, least: float = 0.8) -> list[tuple[int, str, int]]:
    """The examples without near copies: those whose word runs have a Jaccard likeness of `least` to a kept example of the same label.

    Exact: of two such sets the smallest hashes, all but the share `least`, have one in common. Sets are sorted arrays, 8 bytes
    a run, as the driver holds them all at once.
    """
    sets = [_runs(text, n) for _, text, _ in examples]
    heads = [r[: len(r) - int(np.ceil(least * len(r) - 1e-9)) + 1] for r in sets]
    run = np.concatenate([np.empty(0, np.uint64), *heads])
    owner = np.repeat(np.arange(len(heads), dtype=np.int32), [len(h) for h in heads])
    order = np.argsort(run, kind="stable")
    run, owner = run[order], owner[order]
    labels, size = np.array([y for _, _, y in examples]), np.array([len(r) for r in sets])
    kept = np.zeros(len(examples), bool)
    for k, head in enumerate(heads):
        near = np.zeros(len(examples), bool)
        first, last = np.searchsorted(run, head, "left"), np.searchsorted(run, head, "right")
        for f, l in zip(first[last - first > 1], last[last - first > 1]):
            near[owner[f:l]] = True
        near &= kept & (labels == labels[k]) & (np.minimum(size, size[k]) >= least * np.maximum(size, size[k]) - 1e-9)
        for o in np.flatnonzero(near):
            both = len(np.intersect1d(sets[k], sets[o], assume_unique=True))
            if both >= least * (size[k] + size[o] - both) - 1e-9:
                break
        else:
            kept[k] = True
    return [e for e, keep in zip(examples, kept) if keep]


#: Bounds of the log-likelihood ratio of a term and the label, of which cross-validation takes one.
BOUNDS = (30.0, 20.0, 14.0, 10.0, 7.0, 5.0, 3.0)


def occurrences(examples: list[tuple[int, str, int]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All terms of the examples; and by example and term: the example's number, the term's, how often it is there."""
    number: dict[bytes, int] = {}
    rows, cols, times = [], [], []
    for k, (_, text, _) in enumerate(examples):
        n = Counter(t for w in words(text) for t in terms(w))
        rows.append(np.full(len(n), k, np.int32))
        cols.append(np.fromiter((number.setdefault(t, len(number)) for t in n), np.int32, len(n)))
        times.append(np.fromiter(n.values(), np.int32, len(n)))
    return list(number), *(np.concatenate(x) if x else np.empty(0, np.int32) for x in (rows, cols, times))


def ratios(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, use: np.ndarray, n_terms: int) -> np.ndarray:
    """The log-likelihood ratio of each term's presence and the label, over the examples that `use` marks."""
    n = [float((use & (y == k)).sum()) for k in (0, 1)]
    seen = [np.bincount(cols[use[rows] & (y[rows] == k)], minlength=n_terms).astype(float) for k in (0, 1)]
    have, total, g = seen[0] + seen[1], max(sum(n), 1.0), np.zeros(n_terms)

    def part(x, of):
        return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, of, 1))

    for k in (0, 1):
        g += part(seen[k], have * n[k] / total) + part(n[k] - seen[k], (sum(n) - have) * n[k] / total)
    return 2 * g


def largest(g: np.ndarray, least: float, most: int) -> np.ndarray:
    """Numbers, rising, of the terms whose ratio reaches `least`; of more than `most` those of the largest."""
    at = np.flatnonzero(g >= least)
    return np.sort(at[np.argsort(-g[at], kind="stable")[:most]])


def vocabulary_of(examples: list[tuple[int, str, int]], least: float = 30.0, most: int = 8192) -> dict[bytes, int]:
    """Terms whose presence goes with the label in the examples: a log-likelihood ratio of at least `least`, at most `most`
    of the largest. Others say nothing of the label and would drown the few that do in long texts."""
    names, rows, cols, _ = occurrences(examples)
    g = ratios(rows, cols, np.array([e[2] for e in examples]), np.ones(len(examples), bool), len(names))
    return {w: i for i, w in enumerate(sorted(names[t] for t in largest(g, least, most)))}


def held_out_votes(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, splits: list, least: float, most: int, k: int) -> np.ndarray:
    """Each example's vote when terms and neighbours are those of the other folds. splits: (examples of a fold, ratios over the others)."""
    out = np.full(len(y), -0.1)
    for test, g in splits:
        chosen = largest(g, least, most)
        place = np.full(len(g), -1)
        place[chosen] = np.arange(len(chosen))
        mine = place[cols] >= 0

        def unit(use):  # made apart for either side, as a copy of all of them would be the most the driver holds
            at, pick = np.cumsum(use) - 1, mine & use[rows]
            x = np.zeros((int(use.sum()), max(len(chosen), 1)), np.float32)
            x[at[rows[pick]], place[cols[pick]]] = weight[pick]
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-30)
            return x

        others = np.flatnonzero(~test)
        cosine = unit(test) @ unit(~test).T
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        for i, b, c in zip(np.flatnonzero(test), best, np.take_along_axis(cosine, best, 1).astype(float)):
            out[i] = vote(y[others[b]], c)
    return out


def document_counts(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many there are. One row a term and task is shuffled, one a term collected."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of a bounded sample
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        codes, n = _Codes(shared.value), np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[-1] += 1
                have = {i for got in filter(None, map(codes.__getitem__, set(each_word(text)))) for i in got}
                n[list(have)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    df, total = np.zeros(len(vocabulary)), 0
    for r in docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] == len(vocabulary):
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, total


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = 1500, max_bytes: int = 12 << 20, k: int = 15, folds: int = 5, most: int = 8192) -> dict:
    """The examples, the document counts of their terms over all docs, and the calibration of the vote.

    Examples are a bounded labelled sample: per_class rows and max_bytes of text a class, without near copies. The bound
    that makes a term part of the vocabulary is the one of BOUNDS whose held-out votes, by cross-validation, have the
    least loss; so it follows the number of labels. The votes of that bound are calibrated, weighted back to the classes'
    shares among all labels. A class without texts gives a constant score, the smoothed share of label 1.
    """
    keep = F.lit(True) if keep is None else keep
    marked = labels.filter(F.col("doc_id").isNotNull()).withColumn("_id", F.col("doc_id")).filter(keep)
    share = {r["toxic"]: r["n"] for r in marked.filter(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    examples = unlike(labelled_sample(docs, labels, "toxic", keep, per_class, max_bytes))
    examples.sort(key=lambda e: e[2])
    y = np.array([e[2] for e in examples])
    if len(set(y.tolist())) < 2:
        return {"prior": (share.get(1, 0) + 1) / (share.get(0, 0) + share.get(1, 0) + 2)}
    names, rows, cols, times = occurrences(examples)
    fold = np.arange(len(y)) % folds
    splits = [(fold == f, ratios(rows, cols, y, fold != f, len(names))) for f in range(folds)]
    g = ratios(rows, cols, y, np.ones(len(y), bool), len(names))
    counted = sorted({t for r in (g, *(r for _, r in splits)) for t in largest(r, BOUNDS[-1], most).tolist()})
    df, n = document_counts(docs, {names[t]: i for i, t in enumerate(counted)})
    held = np.zeros(len(names))
    held[counted] = df
    weight = (1 + np.log(times)) * np.log((1 + n) / (1 + held[cols]))
    of_class = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    tried = []
    for least in BOUNDS:
        votes = held_out_votes(y, rows, cols, weight, splits, least, most, k)
        knots, values = fit_isotonic(votes, y, of_class)
        p = np.interp(votes, knots, values)
        tried.append((-(of_class * np.where(y == 1, np.log(p), np.log(1 - p))).sum(), -least, knots, values))
    _, least, knots, values = min(tried, key=lambda t: t[:2])
    chosen = sorted(largest(g, -least, most).tolist(), key=lambda t: names[t])
    index = Index(examples, held[chosen], n, {names[t]: i for i, t in enumerate(chosen)})
    version = hashlib.sha256(index.weight.tobytes() + index.ids.tobytes() + values.tobytes()).hexdigest()
    return {"index": index, "knots": knots, "values": values, "k": k, "version": version, "least": -least}


def scored(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """Struct of score (0 to 1, higher where label 1 is likelier) and evidence (ids of the nearest examples) for every text.

    Null texts are empty; a text without any term of the vocabulary has no evidence.
    """
    import pandas as pd

    if "prior" in model:
        return F.struct(F.lit(float(model["prior"])).alias("score"), F.array().cast("array<long>").alias("evidence"))
    small_batches(docs.sparkSession)
    fields = {k: v for k, v in vars(model["index"]).items() if k != "codes"}  # these are made of the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast({**model, "index": fields})  # at most 2 * per_class examples of 8,192 terms

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        index = per_process(("toxicity", m["version"]), lambda: from_fields(Index, {**m["index"], "codes": _Codes(m["index"]["vocabulary"])}))
        for batch in batches:
            votes, evidence = [], []
            for text in batch:
                best, cosine = index.nearest(text, m["k"])
                votes.append(index.vote(best, cosine))
                evidence.append(index.ids[best])
            yield pd.DataFrame({"score": np.clip(np.interp(votes, m["knots"], m["values"]), 0, 1), "evidence": pd.Series(evidence, dtype=object)})

    return F.pandas_udf(run, "score double, evidence array<long>", F.PandasUDFType.SCALAR_ITER)(F.col(text_col))
