"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names in every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logfold.llm import fingerprint, licenses, linededup, mixing, packing, pii, quality, simhash, vafile, warc

LONG = " ".join(f"word{i % 5000} next{i}" for i in range(90_000)) + "\n" + "\n".join(f"line {i}" for i in range(3000))
#: Working names of the operators, and others that callers might use.
CLASHING = [
    "row", "h", "k", "has_id", "no_id", "row_hash", "units", "gone", "left", "node", "root", "s", "salt", "hash", "first", "last", "pos", "kept", "shard", "runs", "whole", "mixed", "copies", "begin", "size", "words", "score", "spans",
    "fingerprint", "range", "head", "place", "part", "ids", "n", "k1", "paragraph", "family", "probability", "label", "u", "__text", "__score", "__h", "__cut", "a.b", "with space",
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, "one two three four five six\nMIT License here\nmail a@b.org"), (4, "one two three four five six\nMIT License here\nmail a@b.org"), (4, "the same id with another text"), (None, "no id at all"), (None, "no id at all"), (None, None)]
    plain = spark.createDataFrame([(i, t, None if k % 4 else "s", None, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars int")
    extra = [F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)]
    return plain.select("*", *extra).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 5)] * 2 + [(None, 1), (2, None)], "doc_id long, quality int")


STAGES = {
    "quality": lambda d, labels: quality.keep(d, quality.train(d, labels), 0.0),
    "line_dedup": lambda d, labels: linededup.drop_repeated_chunks(d),
    "near_dedup": lambda d, labels: simhash.drop_near_duplicates(d),
    "mixing": lambda d, labels: mixing.mixture(d, block=16),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_every_column(table, labels, name):
    out = STAGES[name](table, labels)
    assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema]
    rows = out.collect()
    assert all(r[c] == f"x{k}" for r in rows for k, c in enumerate(CLASHING))
    if name in ("quality", "line_dedup"):
        assert len(rows) == table.count()
    if name == "near_dedup":
        assert sorted((r.doc_id or 0, len(r.text or "")) for r in rows) == [(0, 12), (1, 0), (3, len(LONG)), (4, 29), (4, len("one two three four five six\nMIT License here\nmail a@b.org"))]
    assert STAGES[name](table.limit(0), labels).count() == 0


OPERATORS = {
    "pii": (lambda d: pii.digest(pii.find_pii(d)), 10), "fingerprints": (fingerprint.edited, 10), "simhash": (simhash.near_duplicates, 10), "mix": (mixing.mix, 10),
    "packing": (packing.pack, None), "licences": (lambda d: licenses.scan(d, licenses.train(d, sample_rows=50)), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_any_table(table, name):
    run, rows = OPERATORS[name]
    got = run(table).collect()
    assert rows is None or len(got) == rows
    assert run(table.limit(0)).count() == 0
    if name == "packing":
        assert sum(r.length for r in got) == sum({(r.doc_id, r.doc_tokens, r.sequence_id, r.offset): r.length for r in got}.values())
        assert sum(r.length for r in got if r.doc_id is None) == sum(r.doc_tokens for r in got if r.doc_id is None and r.start == 0)
    if name == "mix":
        assert all(r.taken <= 3 * r["size"] for r in got)
    if name == "simhash":
        assert len({r.component_id for r in got if r.doc_id == 3}) == 1


def test_pii_keeps_every_column(table):
    out = pii.find_pii(table)
    assert sorted(out.columns) == sorted(set(table.columns) - {"text"}) and out.where("size(spans) > 0").count() == 2


def test_pages_and_vectors_of_any_kind(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", "x" * 2_000_000), (1, "u", "x" * 2_000_000), (2, None, "")], "page_id long, url string, html string").withColumn("file", F.lit("x")).withColumn("sha", F.lit("y"))
    records = warc.archive_records(pages)
    assert records.count() == 4 and warc.audit(records, records).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, 1.0]), (2, []), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (100, None)], "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).withColumn("id", F.lit("y"))
    ready = vafile.quantised(vectors, "vec_id", "embedding", 256.0)
    assert [(r.query_id, r["rank"], r.vec_id) for r in vafile.top_k(ready, ready.where("id = 50"), 5).orderBy("rank").collect()] == [(50, 1, 1), (50, 2, 1)]
    assert vafile.top_k(ready.limit(0), ready.limit(0), 5).count() == 0


def test_pipeline_of_odd_rows(spark, table):
    sf = "/root/testdata/sf0.001"
    docs = table.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0
