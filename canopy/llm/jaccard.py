"""Near copies by Jaccard likeness: candidates of SimHash and of MinHash bands, the exact likeness of word shingles, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship, small_batches, stored
from .simhash import components, links, text_fingerprint

ship(__name__)


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The word shingles as op8 cuts them; a shorter text is one shingle, a blank or null one the empty shingle."""
    got = (text or "").encode().lower().split()
    return {b" ".join(got[i : i + words]) for i in range(max(len(got) - words + 1, 1))}


def likeness(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def band_keys(text: str | None, words: int, bands: int, rows: int) -> np.ndarray:
    """One signed key a band, equal where the band's `rows` MinHashes are."""
    import xxhash

    rng = np.random.default_rng(7)
    odd, flip = rng.integers(0, 1 << 64, (2, bands * rows), np.uint64)
    odd |= np.uint64(1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, words)), np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 1024):
        least = np.minimum(least, ((h[k : k + 1024, None] ^ flip) * odd).min(0))
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def bitmap(text: str | None, words: int, most: int = 1 << 14) -> tuple[int, bytes]:
    """How many shingles the text has, and a bit for each hash of them, modulo a power of two of at least four times as many (`most` at most)."""
    import xxhash

    h = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, words)), np.uint64))
    width = min(max(64, 1 << int(np.ceil(np.log2(4 * len(h))))), most)
    bits = np.zeros(width, np.uint8)
    bits[(h % np.uint64(width)).astype(np.int64)] = 1
    return len(h), np.packbits(bits, bitorder="little").tobytes()


def can_reach(n: np.ndarray, root: np.ndarray, bits: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows, two and two, of different root whose sizes and bitmaps allow the likeness: no pair that has it is left out.

    A bit that one bitmap alone has is a shingle that one set alone has, so it bounds the overlap from above. A bitmap of
    twice the width is folded; sets whose widths are further apart differ too much in size.
    """
    width = np.array([len(x) // 8 for x in bits])
    left, right = [], []
    for w in np.unique(width):
        own, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        at = np.concatenate([own, wide])
        m = np.frombuffer(b"".join(bits[i] for i in own), "<u8").reshape(-1, w)
        if len(wide):
            m = np.concatenate([m, np.bitwise_or.reduce(np.frombuffer(b"".join(bits[i] for i in wide), "<u8").reshape(-1, 2, w), 1)])
        ones, size, top = np.bitwise_count(m).sum(1, dtype=np.int64), n[at], root[at]
        for i in range(len(own)):
            j = i + 1 + np.flatnonzero((top[i + 1 :] != top[i]) & (size[i + 1 :] >= least * size[i] - 1e-9) & (size[i] >= least * size[i + 1 :] - 1e-9))
            both = np.bitwise_count(m[j] & m[i]).sum(1, dtype=np.int64)
            overlap = np.minimum(size[i] - ones[i], size[j] - ones[j]) + both
            j = j[overlap >= least / (1 + least) * (size[i] + size[j]) - 1e-9]
            left.append(np.full(len(j), at[i]))
            right.append(at[j])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def apart(members: DataFrame, texts: DataFrame, words: int, least: float, most: int = 8192) -> DataFrame:
    """Pairs (a, b), a < b, of texts (node, text) of one key of members (key, node, root) and different roots that can reach the likeness.

    Pairs are compared inside a task by their bitmaps, and only what passes leaves it. A key of more than `most` members
    is cut into blocks by a hash, each pair of which is a group of its own: exact, and bounded in memory.
    """
    small_batches(members.sparkSession)

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            got = [bitmap(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], names=["node", "n", "bits"])

    def find(batches):
        import pyarrow as pa

        def out(rows):
            a, b = can_reach(np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), [r[4] for r in rows], least)
            node = np.array([r[1] for r in rows], np.int64)
            a, b = node[a], node[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        run, rows = None, []
        for batch in batches:
            for key, part, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "node", "root", "n", "bits"))):
                if (key, part) != run:
                    if len(rows) > 1:
                        yield out(rows)
                    run, rows = (key, part), []
                rows.append((run, *row))
        if len(rows) > 1:
            yield out(rows)

    sketches = stored(texts.join(members.select("node").distinct(), "node").select("node", "text").mapInArrow(sketch, "node long, n long, bits binary"), "sketches")
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > most).select("key", F.ceil(F.col("k") / most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.lit(1 << 16) + F.greatest(own, o))
    dealt = members.join(large, "key", "left").withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(with_each)))
    dealt = dealt.select("key", "part", "node", "root").join(sketches, "node").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.select("key", "part", "node", "root", "n", "bits").mapInArrow(find, "a long, b long").distinct()


def alike(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) reach the likeness."""
    small_batches(pairs.sparkSession)

    def run(batches):
        import pyarrow as pa

        known, mine = None, None
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                if a != known:
                    known, mine = a, shingles(x, words)
                good.append(likeness(mine, shingles(y, words)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, bands: int = 48, rows: int = 5, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of every row: the smallest id reachable over pairs of texts of the likeness `least`.

    Candidates are the SimHash links by pigeonring (fingerprints of the same shingles within `limit` bits) and texts that
    share a MinHash band, as a pair of likeness 0.8 is expected to differ in 9.7 of the 64 bits. A pair of likeness s
    shares no band with probability (1 - s^rows)^bands, 5e-9 at 0.8. All candidates are checked exactly.
    Distinct texts alone are compared. Each is first held against one text of each of its keys, twice; after that the
    texts of keys that are still apart are all compared by bitmaps, which leaves no pair of the likeness out.
    Null texts are empty; rows of null id take part and never name a component unless all its ids are null; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("t", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = batch.column("text").to_pylist()
            fps = [text_fingerprint(t, words) for t in texts]
            keys = [[*band_keys(t, words, bands, rows).tolist(), xxhash.xxh64_intdigest(f.to_bytes(8, "little", signed=True), bands) - (1 << 63)] for t, f in zip(texts, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t", "fp", "keys"])

    own = stored(named.mapInArrow(run, "doc_id long, t binary, fp long, keys array<long>"), "signed")
    distinct = stored(own.groupBy("t").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    of_fp = stored(distinct.groupBy("fp").agg(F.min("node").alias("node")), "fps")
    linked = links(of_fp, limit, fp="fp").join(of_fp.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    linked = stored(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    keys = distinct.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    keys = stored(keys.join(shared, "key").select("key", "node"), "keys")
    nodes = keys.select("node").unionByName(linked.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(distinct.select("node", "t"), "node")
    texts = stored(named.join(nodes, "t").groupBy("node").agg(F.first("text").alias("text")), "texts")
    roots, found, tried = spark.createDataFrame([], "node long, root long"), None, None
    for turn in range(3):
        at = stored(keys.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "apart")
        split = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct((F.xxhash64("node", "key") if turn else F.col("node")).alias("order"), "node", "root")).alias("lead")).filter("low < high")
        if turn < 2:
            pairs = at.join(split.select("key", F.col("lead.node").alias("o"), F.col("lead.root").alias("r")), "key").filter("root <> r")
            pairs = pairs.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))
            pairs = (pairs if turn else pairs.unionByName(linked)).distinct()
        else:
            pairs = apart(stored(at.join(split.select("key"), "key"), "rest"), texts, words, least)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        more = stored(alike(pairs, texts, words, least), "alike")
        found = more if found is None else found.unionByName(more)
        roots = components(found)
    rooted = stored(distinct.join(roots, "node", "left").select("t", "least", F.coalesce("root", "node").alias("root")), "roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("doc_id", "t").join(rooted.join(names, "root").select("t", "component_id"), "t").select("doc_id", "component_id")
