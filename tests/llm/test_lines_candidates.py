"""Long lines that share frequent words are told apart inside the join, and near copies go by their star."""

import random

from pagelode.llm import lines


def counted(monkeypatch):
    """The rows of each scratch table of candidates, as they are written."""
    seen, real = {}, lines.Scratch.save

    def save(self, df, name, *args, **more):
        out = real(self, df, name, *args, **more)
        if name.startswith("met"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(lines.Scratch, "save", save)
    return seen


def plain(texts):
    words = [set(t.split()) for t in texts]
    return {i: int(any(9 * len(words[i] & words[j]) >= 4 * (len(words[i]) + len(words[j])) for j in range(i))) for i in range(len(words))}


def test_few_candidates_of_long_lines(spark, monkeypatch):
    rng = random.Random(11)
    common = [f"w{i}" for i in range(600)]
    texts = [" ".join(rng.sample(common, 150)) for _ in range(60)]
    texts += [t + " new" + str(i) for i, t in enumerate(texts[:5])] + [" ".join(rng.sample(common, 79)) for _ in range(20)] + [texts[-1] + " a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = counted(monkeypatch)
    got = {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()}
    assert got == plain(texts) and sum(got.values()) >= 5
    assert 0 < sum(seen.values()) < 60


def test_near_copies_are_not_all_paired(spark, monkeypatch):
    base = [f"word{i}" for i in range(40)]
    texts = [" ".join([*base[:i % 40], f"own{i}", *base[i % 40 + 1 :]]) for i in range(200)] + [f"other{i % 3} line{i % 7} here{i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = counted(monkeypatch)
    got = {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()}
    assert got == plain(texts) and sum(got.values()) == 199
    assert sum(seen.values()) < 2000
