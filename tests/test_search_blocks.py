"""Postings in blocks of texts: work in proportion to the words, and repeated and missing ids."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from pagelode.operators import search

SCHEMA = "doc_id long, field string, part int, ns int, text string"


def built(spark, tmp_path, rows, name, **more):
    return search.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/{name}", 4, **more)


def test_a_long_text_costs_as_its_words(spark, tmp_path):
    text = lambda n: " ".join(f"word{i % 700}" for i in range(n))
    built(spark, tmp_path, [(1, "text", 0, 0, text(10))], "first")
    took = []
    for n in (500, 8_000):
        t = time.time()
        index = built(spark, tmp_path, [(1, "text", 0, 0, text(n))], str(n))
        took.append(time.time() - t)
        assert index.counts.agg(F.sum("occurrences")).first()[0] == n and index.docs.first().words == n
    assert took[1] < 5 * took[0]


def test_blocks_of_any_size_find_the_same(spark, tmp_path):
    rng = random.Random(3)
    letters = "a b c ä дом_ x1 a".split()
    rows = [(rng.choice([None, *range(12)]), rng.choice(["text", "title", None]), rng.randrange(2), rng.choice([0, 1, None]), rng.choice([None, "", " ".join(rng.choices(letters, k=rng.randrange(1, 9)))])) for _ in range(60)]
    docs, found, inside, total, ids = defaultdict(set), defaultdict(int), defaultdict(lambda: defaultdict(list)), defaultdict(int), defaultdict(set)
    for i, field, part, ns, text in rows:
        words = (text or "").split()
        total[field, ns] += len(words)
        ids[field, ns] |= {i} - {None}
        inside[i, field, part, ns][0] += [words]
        for w in words:
            docs[w, field, ns] |= {i} - {None}
            found[w, field, ns] += 1
    for block in (1, 7, search.BLOCK):
        index = built(spark, tmp_path, rows, f"b{block}", block=block)
        assert {(r.token, r.field, r.ns): (r.docs, r.occurrences) for r in index.counts.collect()} == {k: (len(docs[k]), n) for k, n in found.items()}
        assert {(r.field, r.ns): (r.docs, r.words) for r in index.docs.collect()} == {k: (len(ids[k]), n) for k, n in total.items()}
        for query in ("a", "ä x1", "дом_ b c"):
            got = {(r.doc_id, r.field, r.part, r.ns) for r in search.matches(index, query, ["text", "title"]).collect()}
            assert got == {k for k, texts in inside.items() if k[1] and set(query.split()) <= {w for t in texts[0] for w in t}}, (block, query)
        got = {(r.doc_id, r.field, r.part, r.ns) for r in search.matches(index, "a b", ["text"], phrase=True).collect()}
        sure = {k for k, texts in inside.items() if k[1] == "text" and any(t[j : j + 2] == ["a", "b"] for t in texts[0] for j in range(len(t)))}
        assert sure <= got and {k for k in got if len(inside[k][0]) == 1} <= sure
    assert search.matches(index, ".").count() == 0
