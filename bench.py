"""Headline queries on BENCH_SF_DIR with BENCH_CPUS local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from textward import catalog_queries as C
from textward.config import Config, Language, Ml
from textward.plans.cascade import analyze

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
#: Short prompts, each a conversation turn's first words behind one of the prefixes that set patterns off.
SHORT = 20_000


def headline(spark: SparkSession) -> dict[str, DataFrame]:
    """Stages of the cascade over all documents, dealt over the cores once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as id", "text", "lang", "source").repartition(2 * int(CPUS)).cache()
    docs.count()
    short = C._prompts(spark, SF).selectExpr("left(text, 100) AS text", "explode(sequence(1, 4)) AS k").limit(SHORT).repartition(2 * int(CPUS)).cache()
    short.count()
    from pyspark.sql import functions as F

    from textward.functions.features import features
    from textward.operators import heuristics, language, patterns

    t = F.col("text")
    return {
        # the same work in every round, to tell machines apart; and the scan
        "constant": spark.range(0, 40_000_000, 1, 16).select(F.sum(F.xxhash64("id") % 7)),
        "scan": spark.read.parquet(f"{SF}/documents.parquet").select(F.sum(F.length("text"))),
        "short_prompts_language": short.select(language.gate(t, language.detect(t), Config()).alias("x")),
        "short_prompts_patterns": patterns.with_repetition(short, "text", "r").select(patterns.layer(t, Config(), repeated=F.col("r")).alias("x")),
        "short_prompts_heuristics": short.select(heuristics.layer(t, Config()).alias("x")),
        "language": docs.select("id", language.gate(t, language.detect(t), Config()).alias("x")),
        "patterns_without_repetition": docs.select("id", patterns.layer(t, Config(patterns=C.NO_REPETITION)).alias("x")),
        "patterns": patterns.with_repetition(docs, "text", "r").select("id", patterns.layer(t, Config(), repeated=F.col("r")).alias("x")),
        "heuristics": docs.select("id", heuristics.layer(t, Config()).alias("x")),
        "features": docs.select("id", *features(t, None).values()),
        "short_prompts_cascade": analyze(short).select("verdict"),
        "cascade": analyze(docs).select("id", "verdict"),
        "cascade_without_language": analyze(docs, config=Config(language=Language(enabled=False))).select("id", "verdict"),
        "cascade_light": analyze(docs, config=Config(patterns=C.NO_REPETITION, ml=Ml(enabled=False))).select("id", "verdict"),
    }


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name, df in headline(spark).items():
        runs = []
        for _ in range(RUNS):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs), 3)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    print(json.dumps({"metric": "full cascade over documents, median of 3, warm", "value": took["cascade"], "unit": "sec", "queries": took, "prompts_per_second": {k: round((SHORT if k.startswith("short") else n) / v) for k, v in took.items()}, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
