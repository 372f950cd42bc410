"""What the operators of this subpackage share: shipping code, work folders, text expressions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.shipping import ship

__all__ = ["SPACE", "SPACE_CHARS", "ascii_lower", "saved", "ship", "words_of", "work_dir"]

#: The ASCII white space of the text contracts, as it stands inside a regex class.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); where that is unset, a temp folder on a single
    machine, and an error on a cluster, whose hosts would each write into their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "textward-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textward/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept. lower() does just that where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; empty for null."""
    clean = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(clean, f"[{SPACE}]+"), "")
