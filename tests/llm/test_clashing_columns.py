"""Operators on tables whose further columns have the names that the operators use themselves, and on ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailmark.llm import bpe, convtrie, decontam, htmltext, jaccard, langid, licences, linededup, lmscore, packing, quality, resampling, warc
from trailmark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def table(spark, name, n):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    return df.orderBy(F.xxhash64(*df.columns)).limit(n)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def clashing(df, names):
    """The table with columns of these names that say something else."""
    return df.withColumns({n: F.lit(f"other {n}") for n in names.split() if n not in df.columns})


DOCUMENTS = {
    "lm score": (lmscore.scores, "block ids flags sizes codes words parts score held_out base_score answer part"),
    "quality": (lambda d: quality.verdicts(d, d.sparkSession.read.parquet(f"{SF}/labels.parquet")), "m stratum cuts quality over rule cutoff kept base_failed"),
    "language": (langid.identify, "held_out score lang_pred h rank"),
    "decontamination": (lambda d: decontam.contaminated(d, clashing(d.sparkSession.read.parquet(f"{SF}/benchmark.parquet"), "row h at item size p slots")), "row h hs d p item slots found"),
    "licences": (licences.scan, "digest licence scope n inside head size"),
    "jaccard": (jaccard.join, "set_id n first block tokens places elements component_id"),
    "bpe": (lambda d: bpe.digests(d, tokenizer_path()), "block ids part words answer n_tokens"),
    "lines": (linededup.report, "row at keys key line short doc first gone n"),
    "resampling": (lambda d: resampling.resample(d, clashing(d.sparkSession.read.parquet(f"{SF}/benchmark.parquet"), "bucket n")), "bucket n weight score rank nameless id range at first n_words"),
}


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_documents(spark, name):
    run, names = DOCUMENTS[name]
    docs = table(spark, "documents", 60)
    assert rows(run(clashing(docs, names))) == rows(run(docs))


def test_packing(spark):
    docs = table(spark, "documents", 60)
    found = [packing.pack(d, tokenizer_path()) for d in (docs, clashing(docs, "piece start length chunk at rank sequence_id offset ids"))]
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(found[0].select(*own)) == rows(found[1].select(*own))
    assert found[0].select("sequence_id").distinct().count() == found[1].select("sequence_id").distinct().count()


def test_pages(spark):
    pages = table(spark, "pages", 30)
    assert rows(htmltext.extract(clashing(pages, "text n_chars h"))) == rows(htmltext.extract(pages))
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = [warc.round_trip(p).select(*kept) for p in (pages, clashing(pages, "sha size last first refers_to archive index at n"))]
    assert rows(found[0]) == rows(found[1])


def test_conversations(spark):
    turns = table(spark, "conversations", 80)
    names = "id ids size sizes t base h key chunk name parent_name depth whole ends"
    found = [convtrie.trie(convtrie.rebuilt(convtrie.sequences(t))) for t in (turns, clashing(turns, names))]
    assert rows(found[0]) == rows(found[1])


def test_language_of_odd_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    long = docs.where("lang = 'de'").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).select(F.lit(9_000_001).alias("doc_id"), F.repeat("text", 20).alias("text"), F.lit(None).cast("string").alias("lang"))
    twice = docs.where("doc_id = 7")
    got = langid.identify(docs.unionByName(long).unionByName(twice).unionByName(docs.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("12 !").alias("text"), "lang")))
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert by[9_000_001][0] == "de" and by[None] == ("und", 0.0)
    assert got.where("doc_id = 7").select("lang_pred", "score").distinct().count() == 1 and got.where("doc_id = 7").count() == 2


def test_equal_pages_get_equal_texts(spark):
    page = "<html><body><div class='nav'>Home | About</div><article><p>One &amp; two.</p><p>Three four five.</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"u{i}", page) for i in range(40)], "page_id bigint, url string, html string")
    assert htmltext.extract(pages).select("text", "n_chars").distinct().count() == 1
