"""The pipeline on empty and odd tables; on whole tables it is held against plain stages elsewhere."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "The oring of the retion and thander was inble. It is the of and ander that eaing was then."
DE = "Der einung und die keitlich ist der das und ein nicht ver gehen mit keit der lichung."
ODD = [
    (0, EN, "en", "s", 90),
    (1, None, None, None, None),
    (2, "", "en", None, 0),
    (3, EN + " Then it goes on, " + "and on and on of it, " * 5000, "en", "s", None),
    (4, DE, "de", "s", 80),
    (4, DE, "de", "s", 80),
    (5, EN.upper(), "en", "s", 90),
    (None, EN, "en", "s", 90),
    (None, "A leak of the benchmark: the passage that none may hold in its own text, not here.", "en", "s", 1),
    (6, "123 456 !!", "de", "s", 1),
    (7, "Call +1 (743) 555-3824 of the retion and the thander that was inble, it is.", "en", "s", 1),
]


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
        item = [(0, "the passage that none may hold in its own text, not here"), (1, None)]
        spark.createDataFrame(item, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def test_empty_table(spark, tables):
    assert corpus_pipeline.run(spark, tables([])).collect() == []


def test_odd_rows(spark, tables):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    out = corpus_pipeline.run(spark, tables(ODD))
    rows = out.collect()
    # null, blank and letterless texts have no language; copies leave the least id; the leak goes
    assert sorted(r["doc_id"] for r in rows) == [0, 3, 4, 7]
    assert all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in rows) and out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
    # what stages wrote on the way is gone
    assert len(set(os.listdir(shared)) - before) == 1


def test_every_stage_but_the_last_keeps_the_columns(spark, tables):
    sf_dir = tables(ODD)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_columns_with_names_of_the_operators_keep_their_values(spark, tables):
    """The values of further columns are those of the row, also where an operator adds a column of that name."""
    sf_dir = tables(ODD)
    names = ("score", "lang_pred", "rejected", "n_private", "_own_score", "spans", "token_ids")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
        for r in out.collect():
            assert [r[c] for c in names] == [f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for c in names]
