"""Documents to packed training sequences, in four stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bestfit_packing, compression_langid, paragraph_minhash, simhash_vptree
from tokenloom.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; ``lang`` becomes that language. Learned from
    all labelled documents. Rows are found again by their number, so null and repeated ids are fine."""
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    model = compression_langid.learn(docs)
    found = compression_langid.classify(numbered, model, doc_id="_row").where("not rejected")
    told = found.select(F.col("doc_id").alias("_row"), F.col("lang_pred").alias("_lang"))
    return numbered.join(told, "_row").withColumn("lang", F.col("_lang")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that with the smallest id, and of rows that repeat this id the first.
    Rows are told apart by their number, so another text under the id of a copy stays; rows with a null
    id stay and take no part."""
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    found = simhash_vptree.near_duplicates(numbered.where("doc_id is not null"), doc_id="_row")
    rows = found.select(F.col("doc_id").alias("_row"), "component_id").join(numbered.select("_row", "doc_id"), "_row")
    kept = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("kept"))
    dropped = rows.join(kept, "component_id").where(F.col("_row") != F.col("kept._row")).select("_row")
    return numbered.join(dropped, "_row", "left_anti").select(*docs.columns)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere before; ``n_chars`` follows the text."""
    left = paragraph_minhash.remove(docs, paragraph_minhash.passages(docs))
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that all documents go into, by their words."""
    return bestfit_packing.pack(docs, bestfit_packing.word_count())


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", remove_passages),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # compression sizes, fingerprints and packing have no SQL; tests compare by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``, each but the last written as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
