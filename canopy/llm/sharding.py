"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import spread_rank


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """weight / -ln(u), u the hash of (key, shard) in (0, 1): the largest wins in proportion to the weights."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(float(weight)) / -F.log(u)


def owner(key: Column, weights: list[float]) -> Column:
    """Shard of the largest score; ties go to the smaller shard. Null keys hash like any other value."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    best = F.array_max(F.array(*[F.struct(shard_score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]))
    return (-best["i"]).cast("int")


def assign_shards(docs: DataFrame, weights: list[float] | None = None, grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of each record, its slot in the shard, and its shard once `grown` weights hold.

    Law `key`: id and weights alone decide, so a shard added takes records only into itself.
    Null text: size 1 and the crc32 of no bytes. Null ids go where the hash of null goes.
    Rows of equal id share a shard and get slots of their own. Other columns are ignored; an empty table gives no rows.
    The text is read once and never shuffled; only id, size and checksum are.
    """
    weights = weights or [1.0] * 16
    grown = grown or [*weights, weights[-1]]
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        owner(F.col(id_col), weights).alias("shard"),
        owner(F.col(id_col), grown).alias("grown_shard"),
    )
    out = spread_rank(base, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
