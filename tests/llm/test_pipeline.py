"""The pipeline beside versions of its stages that share no code with them: DuckDB SQL, brute force, the library."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_free_operators import brute, reference_digest
from trailmark.llm.common import stored
from trailmark.llm.oracles import decontamination_sql, line_sql, quality_sql
from trailmark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def asked(folder, documents, sql, sf=SF):
    """Rows of a SQL text by name, over these documents and the given tables."""
    con = duckdb.connect()
    documents.coalesce(1).write.parquet(str(folder))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    for table in ("labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return [dict(zip(names, row, strict=True)) for row in result.fetchall()]


def md5(text):
    return hashlib.md5((text or "").encode()).hexdigest()


def test_stages_one_by_one(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = stored(stage(spark, docs, SF), f"test-{name}")
    columns = inputs[0].columns
    assert all(x.columns == columns for x in inputs)
    ids = [{r.doc_id for r in x.collect()} for x in inputs]
    rules = asked(tmp_path / "1", inputs[0], quality_sql())
    assert ids[1] == {r["doc_id"] for r in rules if r["kept"]}
    lines = asked(tmp_path / "2", inputs[1], line_sql())
    texts = {r.doc_id: r.text for r in inputs[2].collect()}
    blank = {md5("\n" * k) for k in range(500)}
    assert ids[2] == ids[1] - {r["doc_id"] for r in lines if r["n_dropped"] and r["text_md5"] in blank}
    assert {i: md5(t) for i, t in texts.items()} == {r["doc_id"]: r["text_md5"] for r in lines if r["doc_id"] in texts}
    assert all(r.n_chars == len(r.text) for r in inputs[2].collect() if r.text is not None)
    assert ids[3] == {i for i, _, c in brute([(r.doc_id, r.text) for r in inputs[2].collect()]) if i == c}
    bad = {r["doc_id"] for r in asked(tmp_path / "4", inputs[3], decontamination_sql())}
    assert ids[4] == ids[3] - bad
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert {tuple(r) for r in docs.collect()} == {(r.doc_id, *reference_digest(tokenizer, r.text)) for r in inputs[4].collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in docs.collect()}


def test_near_copies_of_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (None, text), (None, "x y z q w"), (None, "x y z q w"), (3, ""), (None, None), (4, text)]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    assert sorted(map(str, got.collect())) == sorted(
        ["Row(doc_id=1, text='a b c d e f g h')", "Row(doc_id=None, text='x y z q w')", "Row(doc_id=3, text='')", "Row(doc_id=None, text=None)"]
    )


@pytest.mark.parametrize("rows", [[], [(None, None, "k", 1, "e", 2, "d"), (1, "", "k", 1, "e", 2, "d"), (1, "", "k", 1, "e", 2, "d"), (2, "w " * 40_000, "k", 1, "e", 2, "d")]])
def test_stages_of_empty_and_odd_tables_with_clashing_names(spark, rows):
    """Further columns that stages use as names of their own, nulls, empty and long texts, repeated rows, no rows."""
    schema = "doc_id bigint, text string, keys string, row bigint, lang string, at bigint, doc string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() <= len(rows)
