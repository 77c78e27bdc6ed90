"""SimHash near-duplicates: pigeonring candidates, then the full Hamming check, then connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship, small_batches, stored

ship(__name__)

BITS = 64


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the text's word shingles with repeats, as a signed number; bit 63 is the highest."""
    import xxhash

    got = (text or "").encode().lower().split()  # ASCII alone is lowered and splits, as bytes
    if not got:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(got) < words:
        value = h64(b" ".join(got), 42)
        return value - (1 << 64) if value >> 63 else value
    line = b" ".join(got)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(got) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for k in range(0, n, 4096):
        h = np.fromiter([h64(line[a:b], 42) for a, b in zip(starts[k : k + 4096], ends[k : k + 4096])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, out: str = "_fp", text_col: str = "text") -> DataFrame:
    """docs with the signed fingerprint of text_col in `out`. Null and blank texts have 0."""
    import pandas as pd

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_fingerprint(t, words) for t in batch], dtype="int64")

    return docs.withColumn(out, F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)(F.col(text_col)))


def ring(segments: int, limit: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most."""
    if not limit < segments <= BITS:
        raise ValueError("pigeonring needs more segments than differing bits")
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def exact_run(segments: int, limit: int) -> int:
    """How many first segments of a chain have a budget below one difference: l * limit / segments < 1."""
    return segments if limit == 0 else -(-segments // limit) - 1


def chain_holds(x: np.ndarray, start: np.ndarray, segments: int, limit: int, chain: int) -> np.ndarray:
    """Whether the chain of `chain` segments from `start` keeps within l * limit / segments at each length l.

    x: the xor of each pair, unsigned. Any pair within the limit has a start for which all lengths hold.
    """
    parts = np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << w) - 1)) for a, w in ring(segments, limit)], 1).astype(np.int64)
    rows, total, ok = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for l in range(1, chain + 1):
        total += parts[rows, (start + l - 1) % segments]
        ok &= total * segments <= l * limit
    return ok


def _link(keys: np.ndarray, fps: np.ndarray, segments: int, limit: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of equal key that the pairs within the limit join, from rows sorted by key.

    Short runs compare each row with the following ones, all runs at once. In long runs a search takes each
    row out of those not yet reached, so a dense group costs little and gives one link a row.
    """
    left, right = [], []
    n = len(keys)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(np.diff(keys)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
    size = last - first
    u = fps.view(np.uint64)
    end = np.repeat(last, size)
    short = np.flatnonzero((np.repeat(size, size) <= 64) & (np.repeat(size, size) > 1))
    for d in range(1, 64):
        short = short[short + d < end[short]]
        if not len(short):
            break
        x = u[short] ^ u[short + d]
        near = np.flatnonzero(chain_holds(x, (keys[short] >> 40).astype(np.int64), segments, limit, chain)) if segments else np.arange(len(x))
        near = near[np.bitwise_count(x[near]) <= limit]
        left.append(fps[short[near]])
        right.append(fps[short[near] + d])
    for r in np.flatnonzero(size > 64):
        rest = np.arange(first[r], last[r])
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                at = front.pop()
                x = u[rest] ^ u[at]
                near = np.bitwise_count(x) <= limit  # the chain of some table holds for it; here the check itself is cheaper
                if near.any():
                    got = rest[near]
                    left.append(np.full(len(got), fps[at]))
                    right.append(fps[got])
                    front += got.tolist()
                    rest = rest[~near]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, limit: int = 3, segments: int = 16, chain: int | None = None, most: int = 20_000, fp: str = "_fp") -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the limit, enough of them to join all that such pairs join.

    fps holds each fingerprint once. By the pigeonring principle a pair within the limit has a segment from which every
    chain stays within its proportional budget, so the chain's first segments, whose budget is below one, are equal:
    a table for each start puts fingerprints of equal first segments together, longer chains prune there, and the
    Hamming distance is checked on what is left. A key with more than `most` fingerprints is cut into blocks by a hash,
    and each pair of blocks is a task of its own: no group is larger than two blocks and no pair is lost.
    """
    chain = segments if chain is None else chain
    run, parts = exact_run(segments, limit), ring(segments, limit)
    value = F.col(fp)
    keys = []
    for s in range(segments):
        key, have = F.lit(0).cast("long"), 0
        for a, w in (parts[(s + j) % segments] for j in range(run)):
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << w) - 1)), have))
            have += w
        keys.append(key.bitwiseOR(F.lit(s << 40)))
    if have > 40:
        raise ValueError("the segments of equal bits must fit 40 bits")
    dealt = fps.select(value.alias("fp"), F.explode(F.array(*keys)).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    many = stored(sizes.filter(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "many")
    hot = many.count()
    if not hot:
        dealt = dealt.withColumn("part", F.lit(0))
    else:
        few = F.broadcast(many) if hot <= 10_000 else many  # else the keys are joined by a shuffle
        cut = dealt.join(few, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
        with_each = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.least(F.col("own"), o) * 30_000 + F.greatest(F.col("own"), o))
        dealt = cut.withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(with_each))).select("fp", "key", "part")
    sorted_ = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp")

    def find(batches):
        import pyarrow as pa

        held_k = held_p = held_f = np.empty(0, np.int64)

        def out(k, p, f):
            # a run is one (key, part); its number stands in for the low bits of the key
            runs = np.cumsum(np.concatenate([[0], (np.diff(k) != 0) | (np.diff(p) != 0)])) if len(k) else k
            a, b = _link((k >> 40 << 40) + runs, f, segments, limit, chain)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            k, p, f = (np.concatenate([h, np.asarray(batch.column(c)).astype(np.int64)]) for h, c in ((held_k, "key"), (held_p, "part"), (held_f, "fp")))
            if not len(k):
                continue
            new = np.flatnonzero((np.diff(k) != 0) | (np.diff(p) != 0))
            end = int(new[-1]) + 1 if len(new) else 0  # the last run may go on
            if end:
                yield out(k[:end], p[:end], f[:end])
            held_k, held_p, held_f = k[end:], p[end:], f[end:]
        if len(held_k):
            yield out(held_k, held_p, held_f)

    return sorted_.select("key", "part", "fp").mapInArrow(find, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node with an edge reaches, by alternating large and small stars.

    Each round writes its edges to the shared folder; ends when a round changes nothing. Nothing is collected
    but counts.
    """
    now = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before = mark(now)
    while before["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        now = stored(small, "small")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 3, segments: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _fp (signed) and component_id of every row: the smallest id reachable over links.

    Equal fingerprints link like any others, 0 of blank and null texts too. Rows of null id take part and get a
    component; they never name one unless all its ids are null. Other columns are ignored; an empty table
    gives no rows. Only distinct fingerprints are compared, so copies cost one row each.
    """
    own = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words).select("doc_id", "_fp"), "fps")
    distinct = stored(own.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "distinct")
    roots = components(links(distinct, limit, segments))
    named = distinct.join(roots, distinct["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    named = stored(named, "roots")
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return own.join(named.join(least, "_root").select("_fp", "component_id"), "_fp").select("doc_id", "_fp", "component_id")
