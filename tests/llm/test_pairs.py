"""Operators 1, 2, 4 and 10 against brute force, with odd texts, ties, repeats and hot groups."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pagelode.llm import lines, minhash, simhash, substrings
from pagelode.llm.components import components
from pagelode.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, pos int"
rng = random.Random(11)
VOCAB = ["w" + str(int(rng.paretovariate(0.7)) % 3000) for _ in range(4000)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "e" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \n\t", "one", "one", "One two", "a b c", prose(5000)]
    shared = prose(70)
    for _ in range(25):
        base = "\n".join(prose(rng.randint(1, 40)) for _ in range(rng.randint(1, 8)))
        out += [base, edited(base, 1), edited(base, 4), base.replace(" ", "  ") if rng.random() < 0.3 else base, prose(30) + "\n" + shared + "\n" + prose(rng.randint(3, 90))]
    hot = prose(120)
    out += [hot] * 30 + [edited(hot, rng.randint(1, 5)) for _ in range(60)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(3 * i + 1, t, None, "s", 0, "n", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:8] + [(None, "no id one two three", "x", "s", 0, "n", "k", 1)], SCHEMA).repartition(5).cache()


def plain(texts):
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def shingled(text, n):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, n, percent):
    sets = {d: shingled(t, n) for d, t in plain(texts)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_duplicates(docs, n, percent).collect()
    assert len(got) == len(texts) + 4
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 5 - n + 1
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_keep_one_of_each(docs):
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and None in ids
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_densified_bins_agree_for_short_sets():
    agree = 0
    for i in range(200):
        base = prose(24)
        a, b = (minhash.band_keys(minhash.shingles(t.encode(), 3)) for t in (base, base + " tail"))
        agree += bool((a == b).any())
    assert agree == 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 201)] + [(300, 300 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(df, Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in (200, 201)}, **{i: 300 for i in range(300, 350)}}


@pytest.mark.parametrize(("window", "gram"), [(13, 6), (5, 2)])
def test_substrings(docs, texts, window, gram):
    first = {}
    for d, t in plain(texts):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    want = {}
    for d, t in plain(texts):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    digests, cut = substrings.dedup(docs, window, gram)
    got = digests.collect()
    assert len(got) == len(texts) + 4
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == want[r.doc_id][2] for r in cut.collect())
    assert substrings.dedup(docs.limit(0))[0].count() == 0


def test_lines(docs, texts):
    seen, gone = [], set()
    for d, t in plain(texts):
        for i, line in enumerate((t or "").split("\n")):
            own = frozenset(words(line))
            if own:
                if any(5 * len(own & s) >= 4 * len(own | s) for s in seen):
                    gone.add((d, i))
                seen.append(own)
    out = lines.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(texts) + 4
    by_id = dict(plain(texts))
    for r in got:
        if r.doc_id is None:
            assert r.text == "no id one two three" and r.n_removed == 0
            continue
        all_ = (by_id[r.doc_id] or "").split("\n")
        left = [x for i, x in enumerate(all_) if (r.doc_id, i) not in gone]
        assert r.n_lines == sum(bool(words(x)) for x in all_) and r.n_removed == len(all_) - len(left)
        assert r.text == (None if by_id[r.doc_id] is None else "\n".join(left) if left or not r.n_removed else "")
    assert lines.dedup(docs.limit(0)).count() == 0


def test_simhash_next(docs, texts):
    rows = [(d, t or "") for d, t in plain(texts)]
    rows = sorted(rows + rows[5:8], key=lambda r: (-r[0], r[1])) + [(None, "no id one two three")]
    want = Counter()
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        a, b, c = (simhash.fingerprint(x.encode()) for x in (t, new, after))
        want[d, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", simhash.likeness(a, b), simhash.likeness(a, c)] += 1
    assert Counter(map(tuple, simhash.against_next(docs).collect())) == want
    assert simhash.against_next(docs.limit(0)).count() == 0
    one = simhash.against_next(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_simhash_search(spark, radius):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(300)]
    for p in prints[:120]:
        for k in (1, 3, 5, 7):
            x = p
            for b in r.sample(range(64), k):
                x ^= 1 << b
            prints.append(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed] + [(None,), (signed[0],)], "fingerprint long")
    want = {(a, b) for i, a in enumerate(sorted(set(signed))) for b in sorted(set(signed))[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    got = [(x.a, x.b) for x in simhash.near(df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_texts_have_equal_fingerprints(docs):
    out = simhash.fingerprints(docs.where("doc_id is not null")).collect()
    assert len({r.doc_id for r in out}) < len(out) and all(r.fingerprint is not None for r in out)
