"""A Python worker remembers the words of one operator at a time."""

import os

import pyarrow as pa

from pagelode.llm import bpe, language
from pagelode.llm.queries import vocabulary


def held(docs):
    """For each worker, the entries that operator 7 has left in it."""

    def run(batches):
        for _ in batches:
            pass
        n = len(bpe.loaded(vocabulary()).of_chunk) if bpe.loaded.cache_info().currsize else 0
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [n]})

    return {r.pid: r.n for r in docs.select("doc_id").mapInArrow(run, "pid long, n long").collect()}


def test_another_operator_starts_afresh(spark):
    docs = spark.range(0, 1600, 1, 16).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', id * 50 + x))) text", "'en' lang")
    digests = bpe.digests(docs, vocabulary()).collect()
    assert len(digests) == 1600 and max(held(docs).values()) > 0
    language.in_a_language(docs, language.fit(docs)).count()
    assert max(held(docs).values()) == 0
    assert bpe.digests(docs, vocabulary()).collect() == digests
