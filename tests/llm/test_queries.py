"""Registered queries on sf0.001: against SQL where there is some, else against plain models; and the pipeline."""

import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tests.llm.cases import documents, no_rows
from tests.llm.test_operators import base
from tokenizers import Tokenizer

from tidelog.llm import ngram_join, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations", "labels", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(llm_spark, duck, name):
    df = queries.QUERIES[name](llm_spark, SF)
    rel = duck.sql(queries.ORACLES[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == sorted((tuple(r) for r in rel.project(", ".join(cols)).fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(llm_spark, name):
    got = queries.QUERIES[name](llm_spark, SF)
    ids = {r[0] for r in got.select("doc_id").distinct().collect()}
    there = {r[0] for r in llm_spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids <= there if name.startswith("op3") else ids == there


def test_pipeline_by_brute_force(llm_spark):
    """Each stage on its predecessor's rows, then run() as a whole."""
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in llm_spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm_spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = llm_spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs, out
        docs = out
    before, after = seen["quality classifier"]
    kept = {r["doc_id"] for r in after.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    before, after = seen["n-gram Jaccard join"]
    classes = {r["doc_id"]: r["class_id"] for r in ngram_join.ngram_join(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == set(classes.values())
    before, after = seen["personal data"]
    assert sum(len(base(r["text"])) for r in before.collect()) > 0 == sum(len(base(r["text"])) for r in after.collect())
    clean = {r["doc_id"]: r["text"] for r in before.collect() if not any(c in r["text"] for c in "@+0123456789")}
    assert all(clean.get(r["doc_id"], r["text"]) == r["text"] for r in after.collect())
    before, after = seen["mixing to target weights"]
    texts = {r["doc_id"]: r for r in before.collect()}
    assert all(r == texts[r["doc_id"]] for r in after.collect())
    before, after = seen["packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {}
    for x in after.collect():
        ids = np.array(tok.encode(texts[x["doc_id"]]["text"], add_special_tokens=False).ids + [2], dtype="<u4")
        assert x["ids_crc32"] == zlib.crc32(ids[x["start"]:x["start"] + x["length"]].tobytes())
        n[x["doc_id"]] = n.get(x["doc_id"], 0) + x["length"] / len(ids)
    copies = {}
    for r in before.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert {k: round(v, 6) for k, v in n.items()} == copies
    ran = corpus_pipeline.run(llm_spark, SF)
    assert ran.columns == after.columns
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in ran.filter("start = 0").collect()) == \
        sorted((r["doc_id"], r["doc_tokens"]) for r in after.filter("start = 0").collect())


def test_stages_on_awkward_rows(llm_spark):
    for df in (documents(llm_spark, 5, True), no_rows(documents(llm_spark, 5))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(llm_spark, df, SF)
            assert out.columns == df.columns
            assert out.count() <= 3 * df.count()
        assert corpus_pipeline.STAGES[-1][1](llm_spark, df, SF).count() >= df.count()
