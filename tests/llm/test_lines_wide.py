"""Bitmaps of long lines leave few pairs to hold whole token sets against."""

import random

from pagelode.llm import lines


def test_only_similar_long_lines_carry_their_sets(spark, monkeypatch):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.sample(common, 150)) for _ in range(40)]
    for n in (70, 78, 82, 100, 155, 158, 162, 200):
        base = rng.sample(common, n)
        texts += [" ".join(base), "\t".join(base[: n - 3]), " ".join([*base[2:], "\x0b", f"new{n}", f"own{n}", f"odd{n}", f"end{n}"])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, real = [], lines.verified

    def counted(pairs, sets):
        seen.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(lines, "verified", counted)
    got = {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()}
    words = [set(t.split()) for t in texts]
    near = [(i, j) for i in range(len(words)) for j in range(i) if 9 * len(words[i] & words[j]) >= 4 * (len(words[i]) + len(words[j]))]
    assert got == {i: int(i in {x for x, _ in near}) for i in range(len(texts))} and len(near) == 24
    assert 0 < sum(seen) <= len(near)
