"""Operator 11 against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pagelode.llm import spelling
from pagelode.llm.common import Scratch

SCHEMA = "doc_id long, text string, word string, n int, gram string, side string, root string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1, "g", "s", "r") for i, t in texts], SCHEMA)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(texts, least_chars=6, least_n=5, factor=5, every=199):
    n = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_n}
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, c in words.items():
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= factor * c else None
    out = Counter()
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w, c, len(near[w]), form[w], form[w] and words[form[w]], root] += 1
    return out


def found(docs, **more):
    return Counter((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, **more).collect())


def test_variants_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    letters = "abcdeéÿ"
    texts = [(None, "nullid nullid"), (1, None), (2, ""), (3, "Straße ÀÉÎÕÜ àéîõü Straße " * 6), (7, "same row here " * 9), (7, "same row here " * 9), (8, "x" * 500 + " ")]
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    for i in range(120):
        words = []
        for _ in range(200):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                k, at = rng.randint(0, 2), rng.randrange(len(w))
                w = w[:at] + (rng.choice(letters) if k else "") + w[at + (k < 2) :]
            words.append(w.title() if rng.random() < 0.1 else w)
        texts.append((i + 10, rng.choice([" ", ", ", "-1-"]).join(words)))
    texts += [(500 + i, "banana bananana aaaaaaa aaaaaaaa aaaaaab " * 5) for i in range(9)]
    texts.append((900, "kettle " * 200 + "kettlo " * 30 + "kettloo " * 5))  # a chain of forms
    docs = table(spark, texts).repartition(5)
    for more in ({}, {"every": 3, "least_n": 2, "factor": 2}):
        got, want = found(docs, **more), plain(texts, **more)
        assert got == want
        assert any(x[2] > 3 for x in got) and (more or any(x[0] == "kettloo" and x[5] == "kettle" for x in got))
    assert spelling.variants(docs.limit(0)).count() == 0


def test_repeated_bigrams_lose_no_pair(spark):
    """Few letters: most words have one bigram at several places."""
    words = ["".join(w) for w in {tuple(random.Random(i).choices("ab", k=6 + i % 3)) for i in range(400)}]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.a, r.b) for r in spelling.near_pairs(rows, Scratch(spark, "test")).collect()}
    assert got == {tuple(sorted(p)) for p in combinations(words, 2) if one_edit(*p)}


def test_chains_of_forms_end_at_their_root(spark):
    rows = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(21)] + [("x", "w20")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(rows, Scratch(spark, "test")).collect()}
    assert set(got.values()) == {"w21"} and len(got) == 22
    with pytest.raises(ValueError):
        spelling.variants(rows.select(F.lit(1).alias("doc_id"), F.col("word").alias("text")), factor=1)
