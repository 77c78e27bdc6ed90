"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import from_fields, ship, stored

ship(__name__)

CENTRES = 16


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


class Quantiser:
    """Coarse centres, and a product quantiser of `width` components a code, 16 centres each, of what they leave.

    For a query q and a vector x, nearness is the inner product of (q, 1) and (x, -|x|^2/2); the last component is
    kept as it is and x is coded: as the number of its nearest coarse centre, and the rest by parts, so that rows of a dense
    cluster have codes fine enough to tell them apart. The loss of a residual r is |r|^2 + (eta - 1) (r.x/|x|)^2: what lies parallel to x
    is penalised eta times, as it is what moves the inner products of the queries that x is near to.
    """

    def __init__(self, sample: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 8, seed: int = 0, coarse: int = 256):
        self.dim = sample.shape[1]
        whole, rng = sample.astype(float), np.random.default_rng(seed)
        self.coarse = whole[rng.choice(len(whole), min(coarse, max(1, len(whole) // 32)), replace=False)]
        for _ in range(rounds):
            a = self.home(whole)
            for k in np.unique(a):
                self.coarse[k] = whole[a == k].mean(0)
        unit, sample = self._unit(whole), whole - self.coarse[self.home(whole)]
        self.parts = [np.arange(a, min(a + width, self.dim)) for a in range(0, self.dim, width)]
        if len(self.parts) % 2:
            self.parts.append(np.arange(0))
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        self.centres = []
        for p in self.parts:
            c = sample[rng.choice(len(sample), CENTRES, replace=len(sample) < CENTRES)][:, p].astype(float)
            for _ in range(rounds):
                a = self._nearest(sample[:, p], c)
                for k in range(CENTRES):
                    if (a == k).any():
                        c[k] = sample[a == k][:, p].mean(0)
            self.centres.append(c)
        for _ in range(rounds // 2):
            codes = self._codes(sample, unit)
            par = self._parallel(sample, unit, codes)
            for j, p in enumerate(self.parts):
                x, u, c = sample[:, p], unit[:, p], self.centres[j]
                rest = par - ((x - c[codes[:, j]]) * u).sum(1)
                new = c.copy()
                for k in range(CENTRES):
                    m = codes[:, j] == k
                    if m.any() and len(p):
                        left = m.sum() * np.eye(len(p)) + (self.eta - 1) * u[m].T @ u[m]
                        new[k] = np.linalg.solve(left, x[m].sum(0) + (self.eta - 1) * ((rest[m] + (x[m] * u[m]).sum(1))[:, None] * u[m]).sum(0))
                self.centres[j] = new
                par = rest + ((x - new[codes[:, j]]) * u).sum(1)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def _parallel(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(((x[:, p] - self.centres[j][codes[:, j]]) * unit[:, p]).sum(1) for j, p in enumerate(self.parts))

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest coarse centre of each row."""
        half = (self.coarse * self.coarse).sum(1) / 2
        return np.concatenate([np.empty(0, np.int64), *((half - x[s : s + 4096] @ self.coarse.T).argmin(1) for s in range(0, len(x), 4096))])

    def _codes(self, x: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of rests by coordinate descent on the anisotropic loss, from the nearest centres."""
        codes = np.stack([self._nearest(x[:, p], self.centres[j]) for j, p in enumerate(self.parts)], 1)
        par = self._parallel(x, unit, codes)
        for _ in range(sweeps):
            for j, p in enumerate(self.parts):
                r = x[:, p][:, None, :] - self.centres[j][None]
                along = (r * unit[:, p][:, None, :]).sum(2)
                rows = np.arange(len(x))
                rest = par - along[rows, codes[:, j]]
                codes[:, j] = ((r * r).sum(2) + (self.eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
                par = rest + along[rows, codes[:, j]]
        return codes.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """A byte of the coarse centre, then two codes of four bits a byte."""
        x = x.astype(float)
        a = self.home(x)
        c = self._codes(x - self.coarse[a], self._unit(x))
        return np.concatenate([a[:, None].astype(np.uint8), c[:, 0::2] | (c[:, 1::2] << 4)], 1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of codes, the inner products of its 256 values."""
        t = np.stack([q[:, p] @ self.centres[j].T for j, p in enumerate(self.parts)], 1).astype(np.float32)
        return (t[:, 0::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), len(self.parts) // 2, CENTRES * CENTRES)


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 16_384) -> tuple[DataFrame, Quantiser | None]:
    """The index: id, original vector and codes of every usable row; and the quantiser, fitted on at most `sample` rows.

    The sample is by the order of a hash of the id. The vectors' length is the most frequent one of all usable rows, the
    larger of equals; vectors of another, which have no distance to the rest, take no part, nor do null ids. Other columns
    are ignored; an id that repeats stays once for each row.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], "id long, v array<double>, codes binary"), None
    rows = rows.filter(F.size("v") == usual["d"])
    some = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
    quantiser = Quantiser(np.array([r["v"] for r in some]))
    shared = spark.sparkContext.broadcast(vars(quantiser))  # 16 centres a code

    def run(batches):
        import pyarrow as pa

        quantiser = from_fields(Quantiser, shared.value)
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([c.tobytes() for c in quantiser.packed(x)], pa.binary())], names=["id", "v", "codes"])

    return stored(rows.mapInArrow(run, "id long, v array<double>, codes binary"), "index"), quantiser


#: Cells of the histogram of approximate scores that each query has.
CELLS = 128


def search(index: DataFrame, quantiser: Quantiser | None, queries: Column, k: int = 10, rerank: int = 512, at_once: int = 4096, sample: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): of each index row that `queries` (a condition on id) holds for, the k nearest others.

    A first scan of the codes counts, for each query, the approximate scores of all rows in cells; so the score is known
    that about `rerank` rows of the whole table reach. A second scan gives these rows, wherever they lie, their Euclidean
    distance from the original vectors. The budget is the same at every size, and neither partitions nor batches change
    the result. Ties go to the smaller id. An id that repeats takes part with each row as candidate, never as its own
    neighbour, and is one query, by its smallest vector. Queries go in ranges of about `at_once` ids, each of which is
    stored before the next begins, so that what is collected and broadcast stays bounded; a scan returns k rows a query and task.
    """
    spark = index.sparkSession
    asked = index.filter(queries)
    n = asked.count()
    if not n or quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_rows = index.count()
    parts = n // at_once + 1
    cuts = sorted({int(c) for c in asked.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    some = np.array([r["v"] for r in index.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(sample).collect()])
    codes, bias = quantiser.packed(some), (some * some).sum(1) / 2
    edges, out = [None, *cuts, None], None
    for low, high in zip(edges, edges[1:]):
        part = asked if low is None else asked.filter(F.col("id") > low)
        part = part if high is None else part.filter(F.col("id") <= high)
        rows = part.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
        if not rows:
            continue
        ids, q = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])
        first = _first_cell(quantiser, q, codes, bias, rerank, all_rows)
        shared = spark.sparkContext.broadcast((vars(quantiser), ids, q, first))
        counts = np.zeros((len(ids), CELLS), np.int64)
        for r in index.select("v", "codes").mapInArrow(_count(shared), "at long, n binary").groupBy("at").applyInArrow(_add, "at long, n binary").collect():
            counts[r["at"] : r["at"] + STRIP] = np.frombuffer(r["n"], np.int64).reshape(-1, CELLS)
        reach = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] >= rerank  # falling: true up to the last cell that is reached by enough
        cell = np.where(reach.any(1), reach.sum(1) - 1, 0)
        wanted = spark.sparkContext.broadcast((vars(quantiser), ids, q, first, cell))
        got = stored(index.mapInArrow(_scan(wanted, k), "query_id long, vec_id long, score double"), "found")
        shared.unpersist()
        wanted.unpersist()
        out = got if out is None else out.unionByName(got)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Queries whose counts travel in one row.
STRIP = 128


def _approximate(quantiser: Quantiser, q: np.ndarray, codes: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Approximate inner products less bias of each query (rows) and code (columns)."""
    t = quantiser.tables(q)
    score = np.take(q @ quantiser.coarse.T, codes[:, 0], axis=1) - bias
    for j in range(t.shape[1]):
        score += np.take(t[:, j], codes[:, j + 1], axis=1)
    return score


def _first_cell(quantiser: Quantiser, q: np.ndarray, codes: np.ndarray, bias: np.ndarray, rerank: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of each query's cells: from well below the score that `rerank` of n rows reach, by a sample, to its best and as far again."""
    place = min(len(codes) - 1, int(4 * rerank * len(codes) / n) + 8)
    low, step = np.empty(len(q)), np.empty(len(q))
    for s in range(0, len(q), STRIP):
        score = np.sort(_approximate(quantiser, q[s : s + STRIP], codes, bias), axis=1)
        low[s : s + STRIP] = score[:, -1 - place]
        step[s : s + STRIP] = 2 * (score[:, -1] - score[:, -1 - place]) / CELLS
    return low, np.maximum(step, 1e-12)


def _cells(score: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The cell of each score; the first holds all below it too, and the last all above."""
    return np.clip((score - low[:, None]) / step[:, None], 0, CELLS - 1).astype(np.int64)


def _blocks(batches, rows: int = 4096):
    """(batch, codes, half squared norms) of at most `rows` rows."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            part = b.slice(s, rows)
            x = np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1)
            yield part, x, np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1), (x * x).sum(1) / 2


def _count(shared):
    def run(batches):
        import pyarrow as pa

        fields, ids, q, (low, step) = shared.value
        quantiser = from_fields(Quantiser, fields)
        counts = np.zeros((len(ids), CELLS), np.int64)
        for _, _, codes, bias in _blocks(batches):
            for s in range(0, len(ids), STRIP):
                e = slice(s, min(s + STRIP, len(ids)))
                cell = _cells(_approximate(quantiser, q[e], codes, bias), low[e], step[e])
                counts[e] += np.bincount((cell + np.arange(len(cell))[:, None] * CELLS).ravel(), minlength=len(cell) * CELLS).reshape(-1, CELLS)
        at = list(range(0, len(ids), STRIP))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([counts[s : s + STRIP].tobytes() for s in at], pa.binary())], names=["at", "n"])

    return run


def _add(table):
    import pyarrow as pa

    total = sum(np.frombuffer(x, np.int64) for x in table.column("n").to_pylist())
    return pa.table({"at": table.column("at").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})


def _scan(shared, k: int):
    def run(batches):
        import pyarrow as pa

        fields, ids, q, (low, step), wanted = shared.value
        quantiser = from_fields(Quantiser, fields)
        none = np.iinfo(np.int64).max
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), none)
        for b, x, codes, bias in _blocks(batches):
            own = np.asarray(b.column("id")).astype(np.int64)
            for s in range(0, len(ids), STRIP):
                e = slice(s, min(s + STRIP, len(ids)))
                row, col = np.nonzero(_cells(_approximate(quantiser, q[e], codes, bias), low[e], step[e]) >= wanted[e, None])
                other = own[col] != ids[e][row]
                row, col = row[other], col[other]
                d = np.zeros(len(row))
                for j in range(x.shape[1]):  # component after component, as SQL sums
                    diff = x[col, j] - q[e][row, j]
                    d += diff * diff
                row, d, i = np.concatenate([row, np.repeat(np.arange(e.stop - s), k)]), np.concatenate([np.sqrt(d), best_d[e].ravel()]), np.concatenate([own[col], best_i[e].ravel()])
                order = np.lexsort((i, d, row))
                row, d, i = row[order], d[order], i[order]
                start = np.searchsorted(row, np.arange(e.stop - s))
                take = (start[:, None] + np.arange(k)).ravel()  # each query has k at least, as k were there
                best_d[e], best_i[e] = d[take].reshape(-1, k), i[take].reshape(-1, k)
        have = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, have.sum(1))), pa.array(best_i[have]), pa.array(best_d[have])], names=["query_id", "vec_id", "score"])

    return run
