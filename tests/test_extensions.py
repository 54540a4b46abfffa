"""Extension reads with nulls, repeats and empty tables; JSON read tolerantly; queries that find something."""

import pytest
from pyspark.sql import functions as F

from pagelode.functions import jsons
from pagelode.operators import activity, extensions
from pagelode.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_json_fields(spark):
    text = '{"a":1.5,"b":"true","c":[1,"x",null,{"y":2},[3],false],"d":{"e":1,"f":null,"g":[1],"h":"t"},"n":" 12 ","bad":"12x","it\'s":7,"t":"20240102030405","one":1}'
    df = spark.createDataFrame([(text,), ("{broken",), (None,), ("[1]",)], "t string").select(jsons.parse("t").alias("v"))
    v = F.col("v")
    row = df.select(
        jsons.string(v, "a").alias("a"), jsons.string(v, "d").alias("d"), jsons.long(v, "n").alias("n"), jsons.long(v, "a").alias("no"), jsons.long(v, "bad").alias("bad"), jsons.double(v, "a").alias("x"),
        jsons.boolean(v, "b").alias("b"), jsons.boolean(v, "one").alias("one"), jsons.flag(v, "missing").alias("f"), jsons.strings(v, "c").alias("c"), jsons.strings(v, "d").alias("none"),
        F.transform(jsons.objects(v, "c"), lambda o: jsons.long(o, "y")).alias("ys"), jsons.texts(jsons.obj(v, "d")).alias("m"), jsons.integer(v, "it's").alias("quote"), jsons.time(v, "t").cast("string").alias("t"),
    ).collect()
    assert row[0].asDict() == {"a": "1.5", "d": None, "n": 12, "no": None, "bad": None, "x": 1.5, "b": True, "one": None, "f": False, "c": ["1", "x", "false"], "none": [], "ys": [2], "m": {"e": "1", "h": "t"}, "quote": 7, "t": "2024-01-02 03:04:05"}
    for r in row[1:]:
        assert r.a is None and r.c == [] and r.ys == [] and r.f is False and r.m is None


def test_logs_of_odd_shape(spark):
    texts = ['{"title":"A","type":"rights","params":[1]}', '{"title":"A","params":{"a":1}}', '{"title":"A","type":"protect","params":{"details":{}}}', '{"title":5,"type":"patrol","params":{"curid":"x"}}', '{"type":"move"}', "no", None]
    got = activity.decode_log(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert sorted(r.details for r in got) == ["patrol", "protect", "rights", "unknown"]
    by = {r.details: r for r in got}
    assert by["rights"].groups_added == [] and by["protect"].protections == [] and by["patrol"].patrolled == 0 and by["unknown"].fields == {"a": "1"}
    assert by["patrol"].title == "5" and by["rights"].log_id is None and str(by["rights"].ts) == "1970-01-01 00:00:00"


def test_flagged_with_reviews_of_gone_revisions(spark):
    cat = {
        "review": spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 99, 5), (2, 20, 1), (None, 30, 1)], "page_id int, rev_id int, level int"),
        "revision": spark.createDataFrame([(1, 10, 100), (1, 11, 110), (1, 12, 105), (2, 20, 1), (3, 30, 1), (None, 30, 1)], "page_id int, rev_id int, ts int"),
    }
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "page_id int")
    got = sorted(tuple(r) for r in extensions.flagged(asked, cat).collect())
    assert got == [(1, 10, 2, 12, 110, 2), (2, 20, 1, 20, None, 0)]
    assert extensions.flagged(asked.limit(0), cat).count() == 0


def test_filters_private_and_without_hits(spark):
    cat = {"filter": spark.createDataFrame([(1, "p", True), (2, "q", False), (3, None, None)], "filter_id int, pattern string, private boolean"), "filter_hit": spark.createDataFrame([(1,), (1,)], "filter_id int")}
    assert [tuple(r) for r in extensions.abuse_filters(cat).select("filter_id", "pattern", "redacted", "n_hits").collect()] == [(1, None, ["pattern"], 2), (2, "q", [], 0), (3, None, [], 0)]
    assert [r.pattern for r in extensions.abuse_filters(cat, may_view_private=True, lowest_first=False, limit=1).collect()] == [None]


def test_new_pages_and_backlog(spark):
    rows = [(1, 0, 5, False, False, "a"), (2, 0, 6, True, False, "a"), (3, 0, 7, False, True, "b"), (4, 0, 8, False, None, None), (5, 1, 9, False, False, "a")]
    cat = {"triage": spark.createDataFrame(rows, "page_id int, ns int, ts int, reviewed boolean, is_redirect boolean, creator string")}
    ids = lambda **kw: [r.page_id for r in extensions.new_pages(cat, **kw).collect()]
    assert ids() == [4, 1] and ids(redirects=True, newest_first=False) == [1, 3, 4] and ids(reviewed=None, creators=["a"]) == [2, 1] and ids(hide_own="a") == [4]
    assert tuple(extensions.backlog(cat, creators=["b"]).collect()[0]) == (4, 1, 3, 5, 1)
    empty = {"triage": cat["triage"].limit(0)}
    assert extensions.backlog(empty).collect()[0].matching == 0 and extensions.new_pages(empty).count() == 0


def test_global_users_without_attached_accounts(spark):
    cat = {
        "account": spark.createDataFrame([("u", "b", 3, True, 2), ("u", "a", 4, True, 2), ("u", "c", 9, False, 1), ("v", "a", 1, False, 1)], "name string, wiki string, edits int, attached boolean, ts int"),
        "global_groups": spark.createDataFrame([("u", "g"), ("u", "g"), ("w", "h")], "name string, grp string"),
    }
    got = extensions.global_users(spark.createDataFrame([("u",), ("u",), ("v",), ("w",), (None,)], "name string"), cat).collect()
    assert [tuple(r) for r in got] == [("u", "a", 2, 7, ["g"], ["a", "b"], ["c"])]


def test_repositories_local_first(spark):
    cat = {"file": spark.createDataFrame([("x", 1, 1)], "title string, ts int, file_id int"), "shared_file": spark.createDataFrame([("x", "r"), ("y", "s"), ("y", "r")], "title string, repository string")}
    got = extensions.repositories_of(spark.createDataFrame([("x",), ("y",), ("z",), (None,), ("y",)], "title string"), cat).collect()
    assert sorted((str(r.title), str(r.repository)) for r in got) == [("None", "None"), ("x", "local"), ("y", "r"), ("y", "r"), ("z", "None")]


@pytest.mark.parametrize("name", ["lint_errors", "notifications", "flagged", "abuse_filters", "new_pages", "global_users", "file_repositories", "contributions_shown", "log_events_of_page", "log_variants"])
def test_queries_find_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
