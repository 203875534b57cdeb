"""Every registered query, and the stages one after another."""

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from test_duplicates import grams, near, without_repeats
from test_text_models import laid, pieces_of

import corpus_pipeline
from hearthline.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    message = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLE[name])
    assert not message or message == "equal only to six digits", message


def test_jaccard_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op4_ngram_jaccard_join"](spark, FOLDER).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in got) == near(rows)


def test_line_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op5_line_dedup"](spark, FOLDER).collect()
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got) == without_repeats(rows)


def test_other_queries_return_a_row_for_each_document(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op7_deleted_interpolation", "op9_temperature_mixing", "op10_language_id"):
        assert QUERIES[name](spark, FOLDER).select("doc_id").distinct().count() == n


def check_stages(spark, docs, columns):
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, FOLDER)
        rows, left = before.collect(), after.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "language_id":
            kept = {repr((r.doc_id, r.text)) for r in left}
            assert {repr((r.doc_id, r.text)) for r in rows if not any(c.isalpha() for c in r.text or "")}.isdisjoint(kept)
            assert all(r.lang is not None for r in left)
        if name == "line_dedup":
            want = [w for w in without_repeats([(r.doc_id, r.text) for r in rows]) if not (eval(w)[2] and eval(w)[2] == eval(w)[3])]  # noqa: S307
            assert sorted(repr(eval(w)[:2]) for w in want) == sorted(repr((r.doc_id, r.text)) for r in left)  # noqa: S307
        if name == "ngram_jaccard_join":
            classes = {}
            for x in near(sorted({(r.doc_id, r.text) for r in rows}, key=repr)):
                doc_id, class_id, _ = eval(x)  # noqa: S307
                classes.setdefault(class_id, []).append(doc_id)
            sets = [grams(r.text) for r in left]
            assert len(left) >= len([c for c in classes if c is not None])
            assert not any(a and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "temperature_mixing":
            assert {repr((r.doc_id, r.text)) for r in left} == {repr((r.doc_id, r.text)) for r in rows}
        if name == "best_fit_packing":
            want = sorted(repr((r.doc_id, *p)) for r in rows for p in pieces_of(r.text))
            assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in left) == want
            laid(left, 1024)
        path = corpus_pipeline.folder(spark, "stage-test")
        after.write.parquet(path)
        before = spark.read.parquet(path)
    return before


def test_stages_on_documents(spark):
    check_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), PLAIN)
    run = corpus_pipeline.run(spark, FOLDER)
    assert run.count() > 0 and "sequence_id" in run.columns


def test_stages_on_odd_documents(spark, odd_documents):
    check_stages(spark, odd_documents, odd_documents.columns)


def test_stages_on_no_documents(spark, no_documents):
    assert check_stages(spark, no_documents, PLAIN).count() == 0


def test_language_stage_without_labels(spark, odd_documents):
    docs = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, docs, FOLDER).count() == docs.count()
