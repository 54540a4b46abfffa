"""Operator 13 against whole texts through both libraries, byte by byte."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelode.llm import alignment
from pagelode.llm.queries import tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, n_a int, block string, key string, place int"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "The quick brown fox isn't here.", "two  spaces   three\n\n\nlines \n mixed\t tabs \r\n", "x" * 400, "<|endoftext|> <s> </s> <unk> <0x41> plain", "▁ lower block", "one▁two three",
    "naïve café Straße ÀÉ ½ ² 日本語 テキスト 12345 678", "emoji 👩‍👩‍👧 \U0001f600 ok", "nbsp here em space \x1c fs \x85 nel", "é Å ﬁ Ａ", "    indented\n    code = [1, 2]; return x++", "a\x00b \x07", "trailing   ",
    "The quick brown fox. " * 300, "foo_bar.baz(qux) // http://a.b/c?d=e&f=%20", "' 's 't don't we'll I'M", ".", "  . ", "\n", "﻿bom", "word​zero",
]


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, 1, "b", "k", 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer(B))


def a_bytes(piece):
    """By the byte-level rule written anew: printable bytes stand for themselves, the others count up from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in keep]
    back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(other)}
    return bytes(back[c] for c in piece)


def b_bytes(piece):
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def whole(text, libraries):
    """ids, groups and links of one text: each byte's token of both sides, and no units."""
    a, b = libraries
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [a_bytes(a.id_to_token(i)) for i in ids_a], [b_bytes(b.id_to_piece(i)) for i in ids_b]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return [], [], [], []
    owner_a, owner_b = ([k for k, p in enumerate(side) for _ in p] for side in parts)
    links = sorted(set(zip(owner_a, owner_b)))
    groups, start = [], (0, 0)
    for at in range(len(owner_a)):
        if at + 1 == len(owner_a) or (owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1]):
            end = owner_a[at] + 1, owner_b[at] + 1
            groups.append((ids_a[start[0] : end[0]], ids_b[start[1] : end[1]]))
            start = end
    return ids_a, ids_b, groups, [(ids_a[x], ids_b[y]) for x, y in links]


def plain(rows, libraries):
    got = [(r.doc_id, *whole(r.text, libraries)) for r in rows]
    count = Counter(p for *_, links in got for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    out = Counter()
    for name, ids_a, ids_b, groups, links in got:
        key = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(key.encode()).hexdigest() if groups else ""
        out[name, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha] += 1
    return out, count


def test_alignment_is_that_of_whole_texts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_UNITS", 100)
    monkeypatch.setattr(alignment, "TOGETHER", 3000)
    monkeypatch.setattr(alignment, "REMEMBER", 500)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    docs = table(spark, TEXTS + real).unionAll(table(spark, ["same id", "other text"], 3)).unionAll(spark.createDataFrame([(None, "no id here", 1, "", "", 0)] * 2, SCHEMA)).repartition(4)
    rows = docs.collect()
    want, count = plain(rows, libraries)
    got = alignment.align(docs, tokenizer(A), tokenizer(B)).collect()
    assert Counter(map(tuple, got)) == want
    assert {(r.a, r.b): r.n for r in alignment.links(docs, tokenizer(A), tokenizer(B)).collect()} == count
    assert sum(1 for x in want if x[1]) > 150 and sum(1 for x in want if not x[1]) >= 4
    assert alignment.align(docs.limit(0), tokenizer(A), tokenizer(B)).count() == 0
    names = docs.where("doc_id < 12").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert Counter(map(tuple, alignment.align(names, tokenizer(A), tokenizer(B)).collect())) == plain(names.collect(), libraries)[0]


def test_groups_of_several_tokens(libraries):
    tokens = alignment.loaded(tokenizer(A), tokenizer(B))
    for text in [t for t in TEXTS if t]:
        a, b, groups, links = whole(text, libraries)
        if groups:
            assert tokens.groups(a, b) == [(tuple(x), tuple(y)) for x, y in groups]
            assert Counter(p for g in tokens.groups(a, b) for p in tokens.links(*g)) == Counter(links)
            assert all(alignment.ids_of(alignment.key_of(*g)) == g for g in tokens.groups(a, b))
