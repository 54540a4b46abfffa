"""Lookups of pages and files: nulls, nothing found, ties and empty tables."""

import datetime

import pytest

from pagelode.operators import lookups
from pagelode.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
ADDED = "literal_pages file_info file_usage files_on all_file_usages global_usage deleted_files interwiki_links protections tracking_categories wikibase_items extracts proofread_quality index_of pages_of".split()


@pytest.mark.parametrize("name", ADDED)
def test_finds_something(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def cat(spark):
    make = spark.createDataFrame
    return {
        "page": make([(1, 0, "A"), (2, 2, "Book/10"), (3, 2, "Book/9"), (4, 3, "Book"), (5, 3, "Copy"), (6, 2, "Book/x")], "page_id long, ns int, title string"),
        "templatelinks": make([(4, 2), (4, 3), (4, 3), (5, 2), (4, 6), (None, 2), (1, 3)], "src_id long, dst_id long"),
        "protections": make([(1, "edit", "sysop", None), (1, "move", "user", datetime.date(2020, 1, 2)), (2, "edit", "user", datetime.date(2020, 1, 1)), (None, "edit", "user", None)], "page_id long, action string, level string, expiry date"),
        "tracking": make([("T",), ("U",), ("T",), (None,)], "category string"),
        "categorylinks": make([(1, "T"), (2, "T"), (1, None)], "page_id long, category string"),
        "attributes": make([(1, "item", "Q1"), (2, "extract", "x"), (None, "item", "Q2")], "page_id long, name string, value string"),
        "file": make([("F", 1, 9, "a"), ("F", 1, 10, "b"), (None, 1, 1, "c")], "title string, ts long, file_id long, sha1 string"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_protections_end_at_their_time(cat):
    assert rows(lookups.protections(cat["page"], cat, datetime.date(2020, 1, 1))) == rows(cat["protections"].where("page_id = 1"))


def test_tracking_categories(cat):
    assert rows(lookups.tracking_categories(cat)) == [("T", 2), ("U", 0)]
    empty = {k: v.limit(0) for k, v in cat.items()}
    assert rows(lookups.tracking_categories(empty)) == []


def test_attributes_and_files(spark, cat):
    asked = cat["page"].where("page_id < 3").select("page_id")
    assert rows(lookups.attributes(asked, cat, "item")) == [(1, "Q1"), (2, None)]
    names = spark.createDataFrame([("F",), ("G",), (None,)], "title string")
    assert {(r.title, r.file_id) for r in lookups.files(names, cat).collect()} == {("F", 10), ("G", None), (None, None)}


def test_index_and_pages(cat):
    scanned = cat["page"].where("ns = 2")
    assert rows(lookups.index_of(scanned, cat, 3)) == [(2, 4), (3, 4), (6, 4)]
    assert rows(lookups.pages_of(cat, 4, 2)) == [(2, "Book/10", 10), (3, "Book/9", 9), (6, "Book/x", None)]
    assert rows(lookups.pages_of(cat, 1, 3)) == []
