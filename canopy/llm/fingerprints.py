"""Document fingerprints by winnowing, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .base import ascii_lower, let

PRIME = 2_147_483_647  # hashes are below it, so that a product of two fits a long
BASE = 1_000_003


def tokens(text: Column) -> Column:
    """Runs without blanks, A-Z lower-cased; runs over 8 code points are cut to pieces of 8, so that a text
    without blanks has k-grams too. An empty text has no token."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("[^\\x20\\x09-\\x0D]{1,8}"), F.lit(0))


def _pairs(a: Column, b: Column, shift: int, size: Column, body) -> Column:
    """body(a[i], b[i + shift]) for as many i as there are; size: the shorter array's after the shift."""
    return F.zip_with(F.slice(a, 1, size), F.slice(b, shift + 1, size), body)


def rolling(h: Column, n: Column, k: int) -> Column:
    """Hashes of all n - k + 1 k-grams of n >= k items: those of 2m items come from two of m, rolled by BASE^m."""

    def roll(by: int):
        return lambda x, y: (x * by + y) % PRIME

    def grow(power: Column, width: int, done: Column | None, have: int, rest: int) -> Column:
        by = pow(BASE, width, PRIME)
        if rest & 1:
            if done is None:
                if rest == 1:
                    return power
                return grow_on(power, width, power, width, rest >> 1)
            joined = _pairs(done, power, have, n - (have + width - 1), roll(by))
            return joined if rest == 1 else let(joined, lambda d: grow_on(power, width, d, have + width, rest >> 1))
        return grow_on(power, width, done, have, rest >> 1)

    def grow_on(power: Column, width: int, done: Column | None, have: int, rest: int) -> Column:
        wide = _pairs(power, power, width, n - (2 * width - 1), roll(pow(BASE, width, PRIME)))
        return let(wide, lambda p: grow(p, 2 * width, done, have, rest))

    return grow(h, 1, None, 0, k)


def winnow(text: Column, k: int = 5, window: int = 4) -> Column:
    """Array of packed selections of a text, in the order of their positions.

    Each item holds hash * 2^32 + (2^32 - 1 - position): the least in a window is the smallest hash and, among
    equal hashes, the rightmost. A run of k + window - 1 tokens that two texts share gives a common hash.
    Texts of fewer than k tokens have one k-gram of all they have, those of fewer k-grams than the window one
    window; empty texts have none.
    """
    if k < 1 or window < 1:
        raise ValueError("k and window must be positive")
    none = F.array().cast("array<bigint>")

    def grams(h: Column, n: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME))
        return F.when(n == 0, none).when(n < k, whole).otherwise(rolling(h, n, k))

    def minima(least: Column, n: Column, width: int) -> Column:
        if width == window:
            return F.array_distinct(least)
        step = min(width, window - width)
        return let(_pairs(least, least, step, n - (width + step - 1), lambda a, b: F.least(a, b)), lambda x: minima(x, n, width + step))

    def select(packed: Column) -> Column:
        n = F.size(packed)
        return F.when(n == 0, none).when(n < window, F.array(F.array_min(packed))).otherwise(minima(packed, n, 1))

    def pack(g: Column) -> Column:
        return F.transform(g, lambda x, i: x * (1 << 32) + (F.lit((1 << 32) - 1) - i))

    hashed = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    return let(hashed, lambda h: let(pack(grams(h, F.size(h))), select))


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 32)))


def positions(selected: Column) -> Column:
    return F.transform(selected, lambda x: F.lit((1 << 32) - 1) - F.pmod(x, F.lit(1 << 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike, one empty is unlike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def digest(selected: Column) -> Column:
    """32 hex digits of the selections with their positions; equal texts have equal digests."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(selected)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), selected)), 16, "0")))


def fingerprint(docs: DataFrame, k: int = 5, window: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and the hashes and positions chosen, for every row. Null texts are empty."""
    got = docs.select(F.col(id_col).alias("doc_id"), winnow(F.coalesce(F.col(text_col), F.lit("")), k, window).alias("_f"))
    return got.select("doc_id", digest(F.col("_f")).alias("fingerprint"), F.transform("_f", lambda x: F.shiftright(x, 32)).alias("hashes"), positions(F.col("_f")).alias("positions"))


def in_order(rows: DataFrame, key: str, ties: str, ranges_a_task: int = 4) -> tuple[DataFrame, WindowSpec]:
    """rows dealt into ranges of key, and a window in which each row of a range is followed by its successor in the
    order of (key, ties); the last row of all by the first.

    Ranges end at quantiles of the key. Their first rows are copied, with _copy true, to the end of the range before,
    and are to be filtered out once lead() has been taken. The driver holds one key a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * ranges_a_task
    keyed = rows.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    cuts = sorted({int(x) for x in keyed.select(F.col("_k").cast("double").alias("_k")).approxQuantile("_k", [i / parts for i in range(1, parts)], 0.25 / parts)})
    keyed = keyed.withColumn("_at", F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda b: b <= F.col("_k"))) if cuts else F.lit(0))
    firsts = sorted((r["_at"], r["k"]) for r in keyed.groupBy("_at").agg(F.min("_k").alias("k")).collect())
    own = F.struct(F.col("_at").alias("at"), F.lit(False).alias("copy"), F.lit(0).alias("late"))
    dest = F.array(own)
    if firsts:
        home = F.create_map(*[F.lit(x) for i, (_, k) in enumerate(firsts) for x in (k, firsts[i - 1][0])])[F.col("_k")]
        copy = F.struct(home.alias("at"), F.lit(True).alias("copy"), F.when(F.col("_k") == firsts[0][1], 1).otherwise(0).alias("late"))
        dest = F.when(home.isNotNull(), F.array(own, copy)).otherwise(dest)
    dealt = keyed.withColumn("_d", F.explode(dest))
    dealt = dealt.select(*rows.columns, "_k", F.col("_d.at").alias("_at"), F.col("_d.copy").alias("_copy"), F.col("_d.late").alias("_late"))
    return dealt, Window.partitionBy("_at").orderBy("_late", "_k", ties)


def edited_pairs(docs: DataFrame, k: int = 5, window: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document,
    in ascending id; rows of equal id are in the order of their text, null ids come first, null texts are empty.
    One row alone is its own next. Other columns are ignored; an empty table gives no rows.
    Texts are shuffled once; the next document's selections come over the same window, so each text is hashed once.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    dealt, order = in_order(base, "doc_id", "_t")
    half = F.floor(F.length("_t") / 2).cast("int")
    both = dealt.withColumn("_n", F.lead("_t").over(order)).withColumn("_e", F.concat(F.substring(F.col("_t"), F.lit(1), F.length("_t") - half), F.substring(F.col("_n"), F.lit(1), half)))
    made = both.select("doc_id", "_t", "_k", "_at", "_copy", "_late", F.length("_t").cast("long").alias("n_chars"), F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"), winnow(F.col("_t"), k, window).alias("_f"), F.when(~F.col("_copy"), winnow(F.col("_e"), k, window)).alias("_g"))
    made = made.withColumn("_h", F.lead("_f").over(order)).filter(~F.col("_copy"))
    made = made.select("*", hashes(F.col("_f")).alias("_a"), hashes(F.col("_g")).alias("_b"), hashes(F.col("_h")).alias("_c"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("_f")).alias("fingerprint"),
        digest(F.col("_g")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
