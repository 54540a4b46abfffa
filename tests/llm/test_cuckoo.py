"""Operator 12: the filter, the index over generations, and exact dedup against a plain version."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import cuckoo

SCHEMA = "doc_id long, text string, id int, digest string, n int, keep_id string, own_text string"
TEXTS = ["a b", "a  b", "a\tb", " a b", None, "", " ", "\n\n", "x" * 5000, "x" * 5000 + " ", "é", "é", "nb sp", "nb sp"]


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts), 0, -1))
    return spark.createDataFrame([(i, t, 0, "d", 1, "k", "o") for i, t in zip(ids, texts)], SCHEMA)


def plain(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    keep, size = {}, Counter()
    for r in rows:
        t = norm(r.text)
        size[t] += 1
        if r.doc_id is not None:
            keep[t] = min(r.doc_id, keep.get(t, r.doc_id))
    out = Counter()
    for r in rows:
        t = norm(r.text)
        out[r.doc_id, keep.get(t), size[t], r.doc_id == keep.get(t), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits", [256, 8])
def test_dedup_is_a_plain_one(spark, bits):
    texts = TEXTS + ["hot copy"] * 300 + [f"text {i % 170}" for i in range(400)]
    rows = table(spark, texts).unionAll(table(spark, ["a b", None, "alone"], [None, None, None])).unionAll(table(spark, ["a b", "x y"], [3, 3])).repartition(5)
    got = cuckoo.dedup(rows, bits).collect()
    assert Counter(map(tuple, got)) == plain(rows.collect())
    assert cuckoo.dedup(rows.limit(0)).count() == 0
    names = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert Counter(map(tuple, cuckoo.dedup(names).collect())) == plain(names.collect())


def test_filter_loses_nothing_and_grows():
    rng = np.random.default_rng(3)
    keys = [int(x) for x in np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))]
    own = cuckoo.Cuckoo(2)
    for k in keys:
        own.insert(k)
    assert all(k in own for k in keys) and own.buckets >= 1024
    others = [int(x) for x in rng.integers(0, 1 << 63, 20000, dtype=np.uint64)]
    assert sum(k in own for k in others) < 40
    again = cuckoo.Cuckoo(own.buckets, own.table.tobytes(), own.keys.tobytes())
    for k in keys[::2]:
        again.delete(k)
    assert all(k in again for k in keys[1::2]) and sum(k in again for k in keys[::2]) < 20
    alike = [5 << 48 | i for i in range(30)]  # one fingerprint, more than two buckets hold
    for k in alike:
        again.insert(k)
    assert all(k in again for k in alike + keys[1::2])


def test_index_over_generations(spark):
    def rows(texts, ids):
        return cuckoo.digests(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).select("digest", "id")

    def live(index):
        return Counter((r.id, r.n) for r in index.keys.collect())

    first = rows(["a", "b", "b", "c"], [1, 2, 3, 4])
    second = rows(["b", "d", "a  a", "c", "c"], [0, 10, 11, 12, 13])
    one = cuckoo.insert(cuckoo.create(first, 3), first)
    assert live(one) == Counter([(1, 1), (2, 2), (4, 1)])
    two = cuckoo.insert(one, second)
    assert live(two) == Counter([(1, 1), (0, 3), (10, 1), (11, 1), (4, 3)])
    three = cuckoo.delete(two, rows(["b", "c", "c", "c", "d"], [0, 4, 12, 13, 99]))
    assert live(three) == Counter([(1, 1), (2, 2), (10, 1), (11, 1)])  # the smallest of those left; unknown rows change nothing
    found = {r.doc: r for r in cuckoo.seen(three, rows(["b", "c", "a a", "new"], [70, 71, 72, 73]).withColumnRenamed("id", "doc")).collect()}
    assert (found[70].keep_id, found[72].keep_id, found[71].keep_id, found[73].keep_id) == (2, 11, None, None)
    marks = sum(sum(1 for m in np.frombuffer(r.slots, "<u2") if m) for r in three.filters.collect())
    assert marks == 4  # one fingerprint a live key
