"""Chunks over many files with a wide column of uneven size, and the entry module without an optional part."""

import sys

import pytest
from pyspark.sql import functions as F

from pagelode.operators import pageset


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_chunks_of_many_files(spark, tmp_path, adaptive):
    n, path = 400_000, str(tmp_path / "pages")
    wide = F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 7 * (F.col("id") % 3)).cast("int"))
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("page_id"), wide.alias("text"), F.lit(1).alias("range_no"))
    rows.repartition(40).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        spark.read.parquet(path).transform(pageset.chunked(50, "page_id")).write.parquet(path + "-out")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    out = spark.read.parquet(path + "-out")
    assert out.columns == ["page_id", "text", "range_no", "chunk"]
    assert out.agg(F.count("*"), F.count_distinct("page_id"), F.count_if(F.col("chunk") != F.floor(F.col("page_id") / 50))).collect()[0] == (n, n, 0)


def test_chunks_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None, i) for i in range(5)] + [("a", i) for i in range(2000)] + [("b", 1)], "k string, i int")
    out = rows.transform(pageset.chunked(500, "k")).collect()
    assert len(out) == 2006 and {r.chunk for r in out if r.k is None} == {0} and [r.chunk for r in out if r.k == "b"] == [4]
    assert sorted(sum(r.chunk == c for r in out) for c in range(5)) == [6, 500, 500, 500, 500]
    assert rows.limit(0).transform(pageset.chunked(5, "k")).count() == 0


def test_entry_without_a_dependency(monkeypatch):
    import __spark_entry__

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("pagelode.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "regex", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    found = __spark_entry__.queries()
    assert "chunk_pages" in found and not any(name.startswith("op1_") for name in found)
