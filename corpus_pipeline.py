"""The corpus pipeline: each stage takes documents and gives those it keeps; the last packs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm import quality, toxicity
from canopy.llm.base import remainder, stored, table
from canopy.llm.jaccard import near_copies
from canopy.llm.lines import dedup_lines
from canopy.llm.packing import pack

#: The score from which a document counts as label 1.
THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, learnt from the labels of the documents table."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("_id", 5) != 0)
    return docs.filter(quality.score_column(docs, model) >= THRESHOLD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold, learnt from the labels of the documents table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("_id", 4) != 2)
    return docs.filter(toxicity.scored(docs, model)["score"] < THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others keep; n_chars is that of the text left."""
    out = dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group of near duplicates: 5-word shingles of Jaccard 0.8 or more.

    Rows that repeat an id are one document, of the smallest text. Rows of null id cannot be told apart by it:
    they stay, one of each text.
    """
    groups = near_copies(docs)
    mark = "__canopy_id"
    winners = groups.filter(F.col("doc_id").isNotNull()).select(F.col("component_id").alias(mark)).distinct()
    kept = docs.join(winners.unionByName(spark.createDataFrame([(None,)], f"{mark} long")), F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")
    first = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.sha2("text", 256))).orderBy("text")
    return kept.withColumn(mark, F.row_number().over(first)).filter(F.col(mark) == 1).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of each document, by its words and an end."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1
    return pack(docs, words)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learnt scores cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
