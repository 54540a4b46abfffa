"""Pairs of texts are met, trimmed and cut once, and odd rows stay as they were."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagelode.operators import diffs
from pagelode.plans.queries import QUERIES


@pytest.fixture()
def plain_plans(spark):
    """Plans as first made, with large tables on both sides of each join."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


def pieces_of(spark, tmp_path):
    """Open pieces as a round reads them."""
    rows = [(1, "a\nb\nc\nd", "x\nb\nc\ny\nd"), (2, "p\nq", "q\np"), (3, "s", "s")]
    pairs = spark.createDataFrame(rows, "rev_id long, before string, after string")
    pairs.write.parquet(f"{tmp_path}/pairs")
    return spark.read.parquet(f"{tmp_path}/pairs").select(F.col("rev_id").alias("k"), F.lit(0).alias("at"), F.lit(0).alias("to"), diffs.lines("before").alias("a"), diffs.lines("after").alias("b"))


def test_ends_are_cut_once(spark, tmp_path):
    pieces = pieces_of(spark, tmp_path).withColumn("final", F.lit(False))
    out = diffs._trimmed(pieces)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "slice(" in x]
    assert sorted((r.k, r["at"], r["to"], r.a, r.b, r.final) for r in out.collect()) == [(1, 0, 0, ["a", "b", "c"], ["x", "b", "c", "y"], False), (2, 0, 0, ["p", "q"], ["q", "p"], False)]


def test_a_round_deals_its_pieces_once(spark, tmp_path, plain_plans):
    pieces_of(spark, tmp_path).write.parquet(f"{tmp_path}/pieces")
    out = diffs._split(spark.read.parquet(f"{tmp_path}/pieces"))
    plan = plain_plans(out)
    dealt = re.findall(r"(?m)^[\s:+-]*Exchange hashpartitioning\((.*?), \d+\)", plan)
    names = sorted(re.sub(r"#\d+L?", "", x) for x in dealt)
    assert names == ["k, at, to", "k, at, to"] and plan.count("FileScan") == 1  # the pieces, and their chains, which have no text
    got = sorted((r.k, r["at"], r["to"], r.a, r.b, r.final) for r in out.where("k = 1").collect())
    assert got == [(1, 0, 0, ["a"], ["x"], False), (1, 3, 3, [], ["y"], True)]


def test_texts_meet_their_parents_in_one_exchange(spark, tmp_path, plain_plans):
    rows = [(p, p * 10 + i, f"text {p} {i}") for p in range(20) for i in range(4)] + [(7, 9000 + i, f"late {i}") for i in range(3)]
    spark.createDataFrame(rows, "page_id long, rev_id long, text string").repartition(3).write.parquet(f"{tmp_path}/r")
    out = diffs.with_parent(spark.read.parquet(f"{tmp_path}/r"), before="text")
    plan = plain_plans(out)
    assert len([x for x in plan.split("\n") if "FileScan" in x and "text:string" in x]) == 1
    want, last = {}, {}
    for page, rev, text in sorted(rows):
        want[rev], last[page] = last.get(page, (None, None)), (rev, text)
    assert {r.rev_id: (r.parent_id, r.before) for r in out.collect()} == want


def test_odd_rows_and_parents(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), (1, None, "c"), (1, 3, None), (1, 3, None), (1, 70000, "e"), (2, 70001, ""), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, rev_id long, text string")
    got = sorted(map(str, ((r.page_id, r.rev_id, r.text, r.parent_id, r.before) for r in diffs.with_parent(df, before="text").collect())))
    want = [(None, 1, "a", None, None), (None, 2, "b", None, None), (1, None, "c", None, None), (1, 3, None, None, None), (1, 3, None, 3, None), (1, 70000, "e", 3, None), (2, 70001, "", None, None), (None, None, None, None, None)]
    assert got == sorted(map(str, want))


def test_the_query_reads_its_pairs_once_and_keeps_odd_rows(spark, tmp_path):
    rows = [(1, "One. Two. One", "en", "s"), (1, "One. Two. One", "en", "s"), (2, None, "fr", "s"), (3, "", None, "s"), (None, "x. y", "en", "s"), (4, "a. b", "de", None), (6, "Z\nZ. Z", "de", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["hunks_applied"](spark, str(tmp_path))
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    md5 = lambda x: x if x is None else hashlib.md5(x.encode()).hexdigest()
    got = sorted((r.rev_id, r.text_md5, r.line_change, r.same) for r in out.collect())
    # of a document that comes twice, the first version follows itself; the second's hunks also meet its own copy, whose first line is its title
    new = "Version of s\nOne.\nTwo.\nOne"
    want = [
        (2, md5("One. Two. One"), 0, True), (3, md5(new), 3, False), (3, md5("\n".join(new.split("\n") + new.split("\n")[1:])), 3, False),
        (5, md5("Version of s\n"), 1, False), (7, md5(""), 0, True), (9, md5(""), 0, False), (13, md5("Version of t\nZ\nZ.\nZ\nde"), 3, False),
    ]
    assert got == sorted(want), got


def test_a_hot_page_sorts_its_rows_once_for_its_ends(spark, tmp_path, plain_plans):
    rows = [(1 if i % 5 else 2 + i, i * 9, f"t{i}") for i in range(2000)]
    spark.createDataFrame(rows, "page_id long, rev_id long, text string").write.parquet(f"{tmp_path}/hot")
    out = diffs.with_parent(spark.read.parquet(f"{tmp_path}/hot"), before="text")
    plan = plain_plans(out).split("\n")
    first = next(i for i, x in enumerate(plan) if "partial_max_by" in x)
    assert "Sort [" not in plan[first + 1]
    want, last = {}, {}
    for page, rev, text in rows:
        want[rev], last[page] = last.get(page, (None, None)), (rev, text)
    assert {r.rev_id: (r.parent_id, r.before) for r in out.collect()} == want
