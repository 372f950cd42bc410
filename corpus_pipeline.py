"""A corpus of documents made ready for training: toxicity, quality rules, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes what each returns as Parquet in
the shared folder and reads it again for the next. All but the last return the columns of documents.

Null and empty texts are scored with the bias alone, fail the quality rules (no words) and so go there. A null doc_id or source stays
a value of its own; rows that repeat a doc_id are documents each, told apart by their texts, and of rows that are the same throughout the
Jaccard join keeps one. Of a group of near duplicates the smallest doc_id stays. Empty tables give empty results; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import line_dedup, packing, quality_rules, shingle_join, toxicity
from textward.llm.common import work_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not reject."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict keep."""
    return quality_rules.keep_good(docs, host="source")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share. The column n_chars, where there is one, follows the text."""
    out = line_dedup.drop_repeated_lines(docs)
    fresh = {"text": F.when(F.col("row.text").isNotNull(), F.col("text")), "n_chars": F.when(F.col("row.n_chars").isNotNull(), F.length("text").cast("long"))} if "n_chars" in docs.columns else {"text": F.when(F.col("row.text").isNotNull(), F.col("text"))}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity 0.8 and more."""
    return shingle_join.keep_first(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: A classifier and a packing have no SQL; tests/llm/test_edges.py holds each stage against a slow version on the same input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = work_dir(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
