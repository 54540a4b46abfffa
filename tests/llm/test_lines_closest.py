"""Token sets of lines go with one pair a line first, and tables go when nothing reads them."""

import os
import random

from pagelode.llm import common, lines


def test_one_pair_a_line_carries_sets_first(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.sample(base, 38) + [f"own{i}", f"odd{i}"]) for i in range(30)] + [f"alone{i} one{i} more{i}" for i in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, real = [], lines.verified

    def counted(pairs, sets):
        seen.append((pairs.count(), pairs.select("x_doc", "x_line").distinct().count()))
        return real(pairs, sets)

    monkeypatch.setattr(lines, "verified", counted)
    got = {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()}
    words = [set(t.split()) for t in texts]
    near = {i for i in range(len(words)) for j in range(i) if 9 * len(words[i] & words[j]) >= 4 * (len(words[i]) + len(words[j]))}
    assert got == {i: int(i in near) for i in range(len(texts))} and len(near) > 20
    assert seen[0][0] == seen[0][1] > 0 and seen[2][0] == seen[2][1]
    root = next(r for r in reversed(common.Scratch.roots) if "/lines-" in r).removeprefix("file://")
    assert "heads" in os.listdir(root) and not {"classes", "keyed", "stars", "by-star-sets"} & set(os.listdir(root))
