import pytest

import __spark_entry__
import corpus_pipeline
from textward.llm import queries

CONTRACTS = {
    "op1_": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op2_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op3_": {"page_id", "url", "text", "n_chars"},
    "op4_": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, "op5_": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op6_": {"vec_id", "n_links", "component_id", "kept"},
    "op7_": {"doc_id", "n_lines", "n_dropped", "kept_sha256"}, "op8_": {"doc_id", "held_out", "score", "predicted"}, "op9_": {"doc_id", "n_shingles", "component_id"}, "op10_": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op11_": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"}, "op12_": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


def test_every_operator_has_one_query_with_its_columns(spark, sf):
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for prefix, columns in CONTRACTS.items():
        own = [n for n in names if n.startswith(prefix)]
        assert len(own) == 1
    for prefix, columns in CONTRACTS.items():
        df = __spark_entry__.queries()[next(n for n in names if n.startswith(prefix))](spark, sf)
        assert columns_of(df) >= columns, prefix


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_the_sqls(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    want = [tuple(dict(zip(names, row, strict=True))[k] for k in sorted(names)) for row in r.fetchall()]
    assert sorted((tuple(row[k] for k in sorted(names)) for row in df.collect()), key=repr) == sorted(want, key=repr)


def columns_of(df):
    return set(df.columns)


def test_stages_keep_the_columns_and_work_on_what_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out = out.cache()
        n = out.count()
        if k < 4:
            assert before is None or n <= before, name
            before = n
        docs = out
    assert docs.select("doc_id").distinct().count() == before
