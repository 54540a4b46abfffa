"""Hot join keys, clashing column names, very long lines, one layout a shard count, and what compaction saves."""

from pyspark.sql import functions as F

from pagelode.llm import common, lines, mixing, quality, sharding, substrings
from pagelode.llm.common import Scratch, lookup


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, None).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 400, 2).select(F.col("id").alias("k"), (-F.col("id")).alias("v"))
    for how in ("inner", "left"):
        got = lookup(rows, table, ["k"], how=how).select("k", "id", "v")
        want = rows.join(table, "k", how).select("k", "id", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_clashing_names_and_very_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    common_ = " ".join(f"c{i % 150}x" for i in range(20_000))
    texts = [long, "a b\n" + long.replace("w7 ", "z "), common_, common_ + " more", "of of of " * 50, "x y z"]
    names = ["own_id", "split_lines", "removed_lines", "_id", "_lines", "plan", "plan_source", "copy", "_copy", "_plan", "words_", "hashes_"]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = rows.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = lines.dedup(rows).collect()
    assert {r.doc_id: r.n_removed for r in out} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}
    assert all(r[n] == k for r in out for k, n in enumerate(names))
    for df in (mixing.mixed(rows), quality.measures(rows)):
        assert all(r[n] == k for r in df.collect() for k, n in enumerate(names))


def test_one_layout_for_each_count():
    assert sharding.tree(9) == sharding.grown(sharding.tree(8), 8) and sharding.tree(11) == sharding.grown(sharding.tree(10), 10)


def test_paths_save_rows(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(400))
    texts = [f"start{i} " * 20 + passage + f" end{i}" * 20 for i in range(30)] + [" ".join(f"p{i}" for i in range(100, 200)) + " z" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    hits = scratch.save(substrings.repeated_segments(scratch.save(substrings.segments(rows, 13, 4), "segments"), scratch), "hits")
    spans = scratch.save(substrings.found_spans(hits, rows, 13, scratch), "spans")
    # one row a path and document, not one an edge: the passage is cut only where document 30 leaves it
    assert hits.count() > 10 * spans.count()
    removed = {r.doc_id: r.n_removed for r in substrings.dedup(rows)[0].collect()}
    assert removed[0] == 0 and all(n >= 400 for d, n in removed.items() if 0 < d < 30) and removed[30] >= 100

    def each_edge(occurrences):  # without compaction: the joins then carry a row for each edge
        return occurrences.where("doc_id = source and start = at").select("source", "at", F.col("n").cast("int").alias("n"))

    monkeypatch.setattr(substrings, "compacted", each_edge)
    other = Scratch(spark, "loose")
    loose = other.save(substrings.found_spans(hits, rows, 13, other), "loose")
    assert loose.count() > 5 * spans.count()
    assert {r.doc_id: r.n_removed for r in substrings.dedup(rows)[0].collect()} == removed
