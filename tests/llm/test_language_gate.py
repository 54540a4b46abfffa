"""The gate of the pipeline's first stage: letters without evidence for a language."""

import random

import pytest

import corpus_pipeline
from pagelode.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(200))
    clean = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("length(text) > 1500").orderBy("doc_id").collect()}
    texts = [junk, "Все люди рождаются свободными и равными " * 20, "มนุษย์ทั้งหลายเกิดมามีอิสระ " * 20, "x" * 5000, "12 !", " ".join(clean.values()), *clean.values()]
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs, docs.unionByName(own, allowMissingColumns=True), len(texts)


def test_gate(spark, rows):
    docs, all_rows, n = rows
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, all_rows, SF).select("doc_id").collect()}
    assert {i for i in range(-n, 0) if i not in kept} == {-1, -2, -3, -4, -5}
    assert {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} <= kept


def test_score_is_evidence(rows):
    docs, all_rows, _ = rows
    got = {r.doc_id: r.score for r in language.identify(all_rows.where("doc_id < 0"), language.fit(docs)).collect()}
    assert got[-2] == got[-3] == got[-4] == got[-5] == 0 and got[-1] < 0.1
    assert all(got[i] > 0.9 for i in got if i < -6)
