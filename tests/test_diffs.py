"""Hunks against a plain patience diff, hunks applied, unified text, parents of hot pages."""

import difflib
import random
from collections import Counter

from pagelode.operators import activity, diffs, listing
from pagelode.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def longest(js):
    """Length of a longest rising chain, by trying all."""
    best = []
    for n, j in enumerate(js):
        best.append(1 + max((best[m] for m in range(n) if js[m] < j), default=0))
    return max(best, default=0)


def settled_pieces(a, b, found):
    """Whether no hunk has shared ends or a line that is single on both sides."""
    for h in found:
        assert h.removed or h.added
        if h.removed and h.added:
            assert h.removed[0] != h.added[0] and h.removed[-1] != h.added[-1]
            x, y = Counter(h.removed), Counter(h.added)
            assert not [w for w in x if x[w] == 1 and y[w] == 1]
        assert a[h.at : h.at + len(h.removed)] == h.removed and b[h.to : h.to + len(h.added)] == h.added


def pairs_of(spark, texts):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(texts)], "rev_id long, before string, after string")


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.rev_id, r.at)):
        out.setdefault(r.rev_id, []).append(r)
    return out


def test_hunks_of_random_texts(spark):
    rng = random.Random(5)
    texts = [(None, None), (None, "a"), ("", ""), ("a", None), ("a\n", "a"), ("\n\n", "\n"), ("x\ny", "y\nx"), ("é\n" * 400, "é\n" * 399 + "z")]
    for _ in range(150):
        a = [rng.choice("abcdefghijklm") * rng.randint(0, 2) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcxyz"))
        if rng.random() < 0.3:
            rng.shuffle(b)
        texts.append(("\n".join(a), "\n".join(b)))
    pairs = pairs_of(spark, texts)
    found = diffs.hunks(pairs).cache()
    per = grouped(found.collect())
    back = {r.rev_id: r.text for r in diffs.applied(pairs, found).collect()}
    for i, (x, y) in enumerate(texts):
        a, b = (x or "").split("\n"), (y or "").split("\n")
        settled_pieces(a, b, per.get(i, []))
        assert back[i] == "\n".join(b)
        assert (i in per) == (a != b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):  # one round is all: the longest chain stays
            kept = len(a) - sum(len(h.removed) for h in per.get(i, []))
            assert kept == longest([b.index(w) for w in a if w in b])
    found.unpersist()


def test_unified_like_the_standard_library(spark):
    a = [f"line {n}" for n in range(40)]
    b = a[:5] + ["new"] + a[6:12] + a[13:30] + ["x", "y"] + a[30:]
    texts = [("\n".join(a), "\n".join(b)), ("a", "a"), ("a\nb", "a\nc"), ("\n".join(a), "\n".join(a[1:])), ("\n".join(a), "\n".join([*a, "end"])), ("p", "q")]
    pairs = pairs_of(spark, texts)
    got = {r.rev_id: r.diff for r in diffs.unified(pairs, diffs.hunks(pairs)).collect()}
    for i, (x, y) in enumerate(texts):
        assert got[i] == "\n".join(difflib.unified_diff(x.split("\n"), y.split("\n"), "page", "page", lineterm=""))


def test_empty_table_and_other_names(spark):
    none = spark.createDataFrame([], "rev_id long, before string, after string")
    assert diffs.hunks(none).count() == 0 and diffs.unified(none, diffs.hunks(none)).count() == 0
    odd = spark.createDataFrame([("r", "x", "y", "k", "a"), (None, "x", "y", "k", "a")], "id string, before string, after string, k string, a string")
    found = diffs.hunks(odd, key="id").collect()
    assert [(r.id, r["at"], r["to"], r.removed, r.added) for r in found] == [("r", 0, 0, ["x"], ["y"])]


def test_parents_of_a_hot_page(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.4 else rng.randint(2, 60), i * 7, rng.randint(0, 99), "t") for i in range(3000)] + [(None, 21001, 1, "t"), (3, None, 1, "t")]
    df = spark.createDataFrame(rows, "page_id long, rev_id long, size long, range_ string").repartition(7)
    last, want = {}, {}
    for page, rev, size, _ in rows:
        before = last.get(page, (None, None)) if page is not None and rev is not None else (None, None)
        want[page, rev] = before
        if page is not None and rev is not None:
            last[page] = (rev, size)
    out = diffs.with_parent(df, was="size")
    assert out.columns == ["page_id", "rev_id", "size", "range_", "parent_id", "was"]
    assert {(r.page_id, r.rev_id): (r.parent_id, r.was) for r in out.collect()} == want
    sizes = {(r.page_id, r.rev_id): r.size_change for r in listing.with_size_change(df).collect()}
    assert all(sizes[p, r] == s - (want[p, r][1] or 0) for p, r, s, _ in rows)
    same = diffs.with_parent(spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "page_id long, rev_id long, size long")).collect()
    assert sorted(str(r.parent_id) for r in same) == ["5", "5", "None"]


def test_contributions_reads_only_the_users_pages(spark):
    df = spark.createDataFrame([(1, 1, 1, "u"), (1, 2, 2, "v"), (2, 3, 1, "u"), (3, 4, 9, "v")], "page_id int, rev_id int, ts int, user string")
    assert {r.rev_id: r.is_top for r in activity.contributions(df, "u").collect()} == {1: False, 3: True}


def test_queries_of_hunks(spark):
    found = grouped(QUERIES["revision_hunks"](spark, SF).collect())
    pairs = {r.rev_id: r for r in diffs.with_parent(spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id as page_id", "conv_id * 100 + turn as rev_id", "text"), before="text").collect()}
    for key, r in pairs.items():
        change = len((r.text or "").split("\n")) - len((r.before or "").split("\n"))
        if r.parent_id is not None:
            assert sum(h.n_added - h.n_removed for h in found.get(key, [])) == change
            assert (key in found) == ((r.text or "") != (r.before or ""))
    assert set(found) <= {k for k, r in pairs.items() if r.parent_id is not None}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES["unified_diffs"](spark, SF).where("n_chars > 0").count() == docs
