"""From raw documents to packed token windows. The driver writes each stage's rows and reads them as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorflow.llm import host_quality, jaccard_join, mixing, packing, pii
from donorflow.llm.common import packed
from donorflow.llm.registry import tokenizer_path
from donorflow.llm.repeats import written


def only(docs: DataFrame, judged: DataFrame, **fresh: Column) -> DataFrame:
    """The columns of `docs` out of the struct `row` of `judged`, those in `fresh` with new values."""
    return judged.select(*[(fresh[c] if c in fresh else F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose source passes.

    Null and empty texts fail and go; repeated rows are judged alike and all stay or go; no rows give no rows. Further columns
    pass through, whatever their names.
    """
    judged = host_quality.judge(packed(docs, text=F.col("text"), source=F.col("source")))
    return only(docs, judged.filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id: five-word shingles, similarity of 0.8 or more.

    Null texts and texts without words are similar to nothing and stay. Rows equal in id and text are one document and stay
    once; rows that share an id only are different ones. A null id comes before all others. No rows give no rows. Further
    columns pass through, whatever their names.
    """
    stays = jaccard_join.link_similar(docs.select("doc_id", "text")).filter("stays").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    rows = packed(docs, id=F.col("doc_id"), hash=F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    rows = rows.join(stays, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    return only(docs, rows.dropDuplicates(["id", "hash"]))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that disclose it; `n_chars` counts the new text.

    Every row stays. Null texts stay null, empty ones empty; repeated rows are treated alike; no rows give no rows. Further
    columns pass through, whatever their names.
    """
    cleaned = pii.sanitise(packed(docs, text=F.col("text"), doc_id=F.col("doc_id")))
    return only(docs, cleaned, text=F.col("sanitised"), n_chars=F.length("sanitised").cast("long"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says.

    A null source is one of its own; null texts have no words and are taken at their source's rate; rows with equal ids draw
    alike; no rows give no rows. Further columns pass through, whatever their names.
    """
    narrow = packed(docs, text=F.col("text"), source=F.col("source"), doc_id=F.col("doc_id"))
    return only(docs, mixing.repeat_rows(mixing.mix_sources(narrow).select("row", "copies")))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; `ids` holds little-endian 32-bit integers.

    A null or empty text is one piece with the closing id alone; repeated rows are packed each; no rows give no pieces. Further
    columns are not read.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("private data", private_data), ("mixing", mixing_weights), ("packing", packed_windows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
