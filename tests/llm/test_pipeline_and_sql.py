"""The registered queries against SQL, and the pipeline against plain versions of its stages."""

import json

import numpy as np
import oracle_check
import plain
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wakeline.llm import language, queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got = oracle_check.actual_rows(queries.registered()[name](spark, sf_dir))
    assert got == oracle_check.expected_rows(oracle_check.connect(sf_dir), SQL[name])


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.registered()] == [f"op{i}" for i in range(1, 14)]
    assert json.dumps(sorted(SQL))


def test_pipeline_equals_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(language.training_sample(docs, "doc_id", "text", "lang"))
    accepted = language.identify(docs, model).where(f"lang_pred <> 'und' AND certainty >= {corpus_pipeline.LEAST_CERTAINTY}")
    rows = [(r.doc_id, r.text) for r in accepted.select("doc_id", "text").collect()]
    assert len(rows) > 0.97 * docs.count()
    assert all(t is not None for _, t in rows)
    left = plain.without_repeated_chunks(rows)
    rows = [(i, left[i][0]) for i, _ in rows if not (left[i][1] and left[i][0] == "")]
    groups = plain.near_groups(rows, corpus_pipeline.NEAR_PERCENT)
    rows = [(i, t) for i, t in rows if groups[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = plain.contamination(rows, items)
    rows = [(i, t) for i, t in rows if not hit[i][1]]
    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path(corpus_pipeline.VOCABULARY))
    want = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes() for i, t in rows}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == want


def test_code_switched_texts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.where("lang IS NOT NULL AND n_chars BETWEEN 300 AND 3000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("t")).collect()
    parts = [" ".join(r.t.split()[:40]) for r in sorted(known, key=lambda r: r.lang)]
    mixed = [(10_000_000 + n, " ".join(parts[:n]), None, "s", 1) for n in range(2, len(parts) + 1)]
    both = docs.unionByName(spark.createDataFrame(mixed, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.identified(spark, both, sf_dir).select("doc_id").collect()}
    assert {m[0] for m in mixed} <= kept and len(mixed) > 2


EDGES = [
    (None, "Was the only one of them", "en", "s", 1), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "123 ...", "en", "s", 7),
    (4, "Was the only one of them and then some more of it", "en", None, 3), (4, "Was the only one of them and then some more of it", "en", None, 3),
    (5, "Zu und der die ein von", "de", "s", 4), (6, "word " * 20000, "en", "s", 5),
]


def test_stages_on_edge_cases(spark, sf_dir):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("score", F.lit("clash"))
    for some in (docs, docs.limit(0)):
        at = some
        for name, step in corpus_pipeline.STAGES:
            before, at = at, step(spark, at, sf_dir)
            if name != "packing":
                assert at.columns == docs.columns
            at = spark.createDataFrame(at.collect(), at.schema)
        found = {r.doc_id for r in at.collect()}
        assert found <= {None, 4, 5, 6} and (not found or {4, 6} <= found)
