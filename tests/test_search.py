"""The inverted index against plain scans."""

import re

import pytest
from pyspark.sql import functions as F

from pagelode.operators import search

TEXTS = [
    (1, 0, "Москва Дом", "Это Москва, а не дом."), (2, 0, "Café noir", "un café noir; le noir café"), (3, 1, "Plain", None), (4, 1, "café NOIR", "x_y x y 2024 हिन्दी भाषा"),
    (5, 0, "Repeats", "a a a a b a"), (6, 2, None, ""), (7, 0, "Dom 10", "дом " * 300), (8, 0, "Dom 9", "москва дом"), (9, 0, "Empty", " \n.,"),
]


def plain_words(text):
    return re.findall(r"[\wऀ-ॿ]+", (text or "").lower())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    pages = spark.createDataFrame([(i, n, t, x, i * 2, -i) for i, n, t, x in TEXTS], "page_id long, ns int, title string, text string, ts int, created int")
    path = str(tmp_path_factory.mktemp("index"))
    return search.build(search.of_pages(pages), f"file://{path}/i", 16), pages


def ids(df):
    return [r.page_id for r in df.collect()]


def test_words_of_any_script(index):
    got, pages = index
    for query in ["МОСКВА дом", "café", "noir CAFÉ", "हिन्दी", "x_y", "a b", "2024", "missing", "дом missing", "."]:
        want = {i for i, _, _, t in TEXTS if plain_words(query) and set(plain_words(query)) <= set(plain_words(t))}
        assert set(ids(search.search(got, pages, query))) == want, query
        want = {i for i, _, t, _ in TEXTS if plain_words(query) and set(plain_words(query)) <= set(plain_words(t))}
        assert set(ids(search.search(got, pages, query, scope="title"))) == want, query
    assert set(ids(search.search(got, pages, "café", scope="title", namespaces=[1]))) == {4}
    assert ids(search.search(got, pages, "CAFÉ Noir", scope="near_match", sort="none")) == [2, 4]


def test_phrases_and_sorts(index):
    got, pages = index
    assert ids(search.search(got, pages, "café noir", phrase=True)) == [2] and ids(search.search(got, pages, "noir un", phrase=True)) == []
    assert ids(search.search(got, pages, "a a b a", phrase=True)) == [5] and ids(search.search(got, pages, "b a a", phrase=True)) == []
    assert ids(search.search(got, pages, "дом", sort="last_edit_asc")) == [1, 7, 8] and ids(search.search(got, pages, "дом", sort="create_asc")) == [8, 7, 1]
    assert ids(search.search(got, pages, "дом", sort="title")) == [8, 7, 1]  # 9 before 10
    assert ids(search.search(got, pages, "дом", limit=1)) == [7]  # nothing else in it
    with pytest.raises(ValueError):
        search.search(got, pages, "x", sort="best")
    with pytest.raises(ValueError):
        search.search(got, pages, "x", scope="all")


def test_only_asked_buckets_are_read(index):
    got, _ = index
    rows = search._read(got.postings, ["дом", "noir"], ["text"], got.buckets)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    wanted = {r[0] for r in rows.sparkSession.range(1).select(F.explode(F.array(search.bucket_of(F.lit("дом"), got.buckets), search.bucket_of(F.lit("noir"), got.buckets)))).collect()}
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan, re.S)
    assert {int(x) for x in re.findall(r"bucket#\d+ = (\d+)", filters[1])} == wanted and "дом" in filters[2]
    assert "text" not in re.search(r"ReadSchema: (\S+)", plan)[1]


def test_entities_fall_back(spark, tmp_path):
    rows = [("Q1", {"en": "Paris town"}, {"en": "a town"}, {"en": ["City of Light", "Lutetia"]}), ("Q2", {"mul": "Paris"}, {"mul": "d"}, None), ("Q3", {"fr": "Paris"}, None, None), ("Q4", None, None, {"en": ["old Paris"], "mul": ["Paris"]})]
    found = spark.createDataFrame([(i, "item", a, b, c) for i, a, b, c in rows], "id string, kind string, labels map<string,string>, descriptions map<string,string>, aliases map<string,array<string>>")
    index = search.build(search.of_entities(found), f"file://{tmp_path}/e", 4)
    got = [tuple(r) for r in search.search_entities(index, found, "PARIS").collect()]
    assert got == [("Q1", "Paris town", "a town", "en", False), ("Q4", None, None, "en", True), ("Q2", "Paris", None, "mul", False)]
    assert [r.id for r in search.search_entities(index, found, "light city").collect()] == ["Q1"]
    assert search.search_entities(index, found, "old light").count() == 0 and search.search_entities(index, found, "Paris", kind="property").count() == 0
    with pytest.raises(ValueError):
        search.search_entities(index, found, "x", kind="mediainfo")


def test_empty_index(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, ns int, title string, text string")
    index = search.build(search.of_pages(pages), f"file://{tmp_path}/n", 4)
    assert search.search(index, pages, "x", sort="none").count() == 0
