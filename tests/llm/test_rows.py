"""The operators that give each document a row of its own: 3, 5, 6, 7 and 8."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pytest

from pagelode.llm import bpe, grammar, mixing, quality, sharding
from pagelode.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, shard string"
ODD = [
    None, "", " \t\n", "one", "The quick brown fox isn't here. ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ς Σ É é ß İ ǆ", "x" * 3000,
    "same line here\nsame line here\n\nother\n \nsame line here", "one two three four five six seven eight nine " * 6, "### $$$ word*** " * 30,
    "a b c d e f g h " + " ".join("ab" + "abcdefghij"[i % 10] + "klmnopqr"[i // 10] for i in range(60)) + " a b c d e f g h", "日本語 テキスト 12345 ½ ²", "tab\tand\x0bvt\x1cfs nbsp em\x85nel", "Å é",
]


def rows(texts, start=0):
    return [(i + start, t, None, None if i % 5 == 4 else f"s{i % 4}", 0, "x", "y", "z") for i, t in enumerate(texts)]


def table(spark, texts):
    r = rows(texts)
    return spark.createDataFrame(r + r[3:5] + [(None, "no id", None, "s0", 1, "", "", "")], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_is_the_library(spark, library):
    docs = table(spark, ODD)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw, text = np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs, vocabulary()).collect())) == want
    assert bpe.digests(docs.limit(0), vocabulary()).count() == 0
    got = {r.doc_id: r for r in bpe.encode(docs.where("doc_id = 4"), vocabulary()).collect()}
    assert got[4].decoded == library.decode(np.frombuffer(got[4].ids, "<u4").tolist(), skip_special_tokens=False)


def test_rank_array_word(library):
    own = bpe.WordBpe(vocabulary())
    for w in ["a", "hello", "unbelievably", "zzzzzzzz", "éléphant", "日本語", "thththth", "!!!???", "ab" * 40]:
        assert own.encode_word(w) == library.encode(w, add_special_tokens=False).ids


def test_token_files(spark, library):
    docs = table(spark, [*ODD, *["the cat sat on the mat and " * 400] * 3])
    got = grammar.round_trip(docs, vocabulary()).orderBy("start").collect()
    at = 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert tuple(got.pop(0)) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert grammar.round_trip(docs.limit(0), vocabulary()).count() == 0


def test_grammar_ends_only_when_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    passage = rng.permutation(60).astype("<u4")
    inputs = [np.tile(passage, 400), np.zeros(3000, "<u4"), np.tile(np.array([1, 1, 2], "<u4"), 500), rng.zipf(1.5, 6000).clip(0, 50).astype("<u4")]
    inputs += [rng.integers(0, rng.integers(1, 6), rng.integers(0, 400)).astype("<u4") for _ in range(40)]
    for x in inputs:
        base, rules, lengths, symbols = grammar.compress(x, 12)
        assert (grammar.decompress(base, rules, lengths, symbols) == x).all()
        pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < 12
    # a passage that comes 400 times becomes rules that stand for all of it
    assert grammar.compress(inputs[0], 12)[2].max() >= 60


def test_grammar_compresses_and_reads_anywhere():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile([5, 6, 7, 5, 6], 500), rng.zipf(1.3, 5000) % 900, [3]]).astype("<u4")
    base, rules, lengths, symbols = grammar.compress(ids)
    assert len(symbols) < 0.7 * len(ids) and len(rules)
    assert (grammar.decompress(base, rules, lengths, symbols) == ids).all()
    assert (np.array([len(grammar.decompress(base, rules, lengths, np.array([base + i], "<u4"))) for i in range(len(rules))]) == lengths).all()
    row = {"base": base, "rules": rules.tobytes(), "rule_lengths": lengths.tobytes(), "symbols": symbols.tobytes()}
    for a, b in [(0, 1), (0, len(ids)), (777, 790), (2499, 2503), (len(ids) - 1, len(ids)), (9, 9)]:
        assert (grammar.decode_range(row, a, b) == ids[a:b]).all()
    for few in ([], [4], [4, 4], [1] * 100):
        x = np.array(few, "<u4")
        assert (grammar.decompress(*grammar.compress(x)) == x).all()


def base_measures(text):
    w, t = words(text), text or ""
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark):
    docs = table(spark, ODD).withColumnRenamed("size", "n_words")
    rows_ = quality.measures(docs)
    out = quality.cascade(rows_.withColumn("base_failed", quality.base_failed()), rejected=quality.base_failed()).collect()
    assert len(out) == docs.count()
    for r in out:
        want = base_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.text
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert not kept[10] and kept[11]
    assert quality.cascade(quality.measures(docs.limit(0))).count() == 0


def test_quality_verdict_holds_in_any_order(spark, monkeypatch):
    rows_ = quality.measures(table(spark, ODD))
    one = quality.cascade(rows_).select("doc_id", "kept").collect()
    monkeypatch.setattr(quality, "fit_order", lambda rows, rules, text_col, rejected: list(reversed(rules)))
    assert Counter(one) == Counter(quality.cascade(rows_).select("doc_id", "kept").collect())


def test_sharding_law(spark):
    docs = table(spark, [f"text {i}" for i in range(3000)])
    root = sharding.tree(8)
    out = sharding.place(docs, root, sharding.grown(root, 8)).collect()
    assert len(out) == 3003
    moved = [r for r in out if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 8 for r in moved) and len(moved) < 3003 / 6
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 250
    assert {r.doc_id: (r.size, r.text_crc32) for r in out}[7] == (7, zlib.crc32(b"text 7"))
    assert sharding.place(docs.limit(0), root).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    a = sharding.Node("root", (sharding.Node("e", (sharding.Node("e1", (), 0), sharding.Node("e2", (), 1))), sharding.Node("f", (sharding.Node("f1", (), 2), sharding.Node("f2", (), 3)))))
    b = sharding.Node("root", (sharding.Node("e", (sharding.Node("e1", (), 0, 0.5), sharding.Node("e2", (), 1))), a.children[1]))
    out = sharding.place(table(spark, ["t"] * 2000), a, b).collect()
    assert any(r.shard != r.grown_shard for r in out)
    assert all(r.shard == r.grown_shard for r in out if r.shard in (2, 3))  # f's subtree only gains


def wanted(sizes, weights=(5.0, 2.0, 1.0)):
    """Targets by rounds: capped sources leave, the others share what is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)


def test_mixing(spark):
    docs = table(spark, list(chain(ODD, (" ".join(["w"] * (i % 37)) for i in range(1500)))))
    out = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = wanted(dict(sizes))
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(0 <= want[s] - taken[s] < 800 for s in sizes)
    assert Counter(out) == Counter(mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("text = ''")).collect()} == {0}
