"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BLANKS, ascii_lower, let, stored


def line_key(line: Column) -> Column:
    """The line without blanks at either end and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with all its columns, text_col without the lines dropped, and _n_lines, _n_dropped.

    A key of at least min_chars code points that at least min_docs documents hold loses its lines
    in all documents but the one of the largest id. Null and empty texts are one empty line, and null
    becomes empty. Repeats of a key in one document count once; rows of equal id count as documents of
    their own but keep or lose a key together. Null ids are the smallest. Columns named _n_lines or
    _n_dropped in the input are replaced. An empty table gives no rows.

    Lines are hashed to 128 bits; keys are counted with partial sums, so a line that all documents hold
    is one row a task. Texts are shuffled once, by id and hash, to meet the positions that go.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The input's columns travel in one struct, so that none clashes with those made here.
    keep = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    own = docs.select(F.struct(*[F.col(c) for c in keep if c != text_col], text.alias(text_col)).alias("_doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(text).alias("_row"))
    text = F.col("_doc")[text_col]
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), line_key(x).alias("key")))
    hashed = F.transform(F.filter(lines, lambda s: F.length(s["key"]) >= min_chars), lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["key"]).alias("h"), F.xxhash64(F.lit(7), s["key"]).alias("g")))
    long = stored(own.select("_id", "_row", hashed.alias("_long")).filter(F.size("_long") > 0), "lines")
    keys = long.select("_id", F.explode(F.array_distinct(F.transform("_long", lambda s: F.struct(s["h"].alias("h"), s["g"].alias("g"))))).alias("k"))
    common = keys.groupBy(F.col("k.h").alias("h"), F.col("k.g").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("_last")).filter(F.col("n") >= min_docs)
    at = long.select("_id", "_row", F.explode("_long").alias("s")).select("_id", "_row", "s.at", "s.h", "s.g")
    # Keys that hold more than a thousandth of all long lines are fewer than a thousand: they are broadcast, the rest is shuffled.
    lines_in_all = long.agg(F.sum(F.size("_long")).alias("n")).first()["n"] or 0
    common = stored(common, "common")
    often = F.broadcast(common.filter(F.col("n") * 1000 > lines_in_all).drop("n"))
    seldom = common.filter(F.col("n") * 1000 <= lines_in_all).drop("n")
    gone = at.join(often, ["h", "g"]).unionByName(at.join(often, ["h", "g"], "left_anti").join(seldom, ["h", "g"])).filter(F.col("_id") != F.col("_last"))
    # Equal rows share (_id, _row), so a position may come once for each of them.
    gone = gone.groupBy("_id", "_row").agg(F.collect_set("at").alias("_gone"))
    split = F.split(text, "\n", -1)
    kept = let(split, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)))
    joined = own.join(gone, ["_id", "_row"], "left")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in keep],
        F.size(split).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_dropped"),
    )
