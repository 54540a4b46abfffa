"""No labels, stable orders, ranges of a grammar, string ids, and stages on empty tables."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagelode.llm import grammar, language, quality, simhash

SF = "/root/testdata/sf0.001"


def test_texts_stay_where_nothing_is_labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 !"), (-4, "é"), (-5, "слово")], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(odd, allowMissingColumns=True), SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {-4, -5}
    assert language.in_a_language(docs.limit(0), language.fit(docs)).count() == 0


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.token_ids(spark, docs, SF).count() == 0


def test_rules_have_one_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    orders = {tuple(r.name for r in quality.fit_order(docs, quality.RULES, rejected=quality.base_failed())) for _ in range(2)}
    orders |= {tuple(r.name for r in quality.fit_order(docs, quality.RULES[::-1], rejected=quality.base_failed()))}
    assert len(orders) == 1
    flags = [(~quality.base_failed() & r.rejects(F.col("text"))).alias(r.name) for r in quality.RULES]
    rejected = quality.measures(docs).select(*flags).agg(*[F.count_if(r.name).alias(r.name) for r in quality.RULES]).first()
    none = {r.name for r in quality.RULES if not rejected[r.name]}
    found = orders.pop()
    assert set(found[len(found) - len(none) :]) == none  # rules that reject nothing come last
    assert len(quality.fit_order(docs.limit(0), quality.RULES)) == len(quality.RULES)


def test_ranges_expand_what_covers_them():
    rng = np.random.default_rng(2)
    parts = [rng.permutation(900)[:40].astype("<u4") for _ in range(60)]
    ids = np.concatenate([parts[i] for i in rng.integers(0, 60, 3000)])
    base, rules, lengths, symbols = grammar.compress(ids)
    row = {"base": base, "rules": rules.tobytes(), "rule_lengths": lengths.tobytes(), "symbols": symbols.tobytes()}
    for start in rng.integers(0, len(ids) - 10, 20).tolist():
        assert (grammar.decode_range(row, start, start + 10) == ids[start : start + 10]).all()
    one = symbols[:1]
    used = grammar.reached(base, rules, one)
    size = int(lengths[int(one[0]) - base]) if one[0] >= base else 1
    assert len(used) < size and len(used) < len(rules) / 10  # a rule for each id at most, out of all
    assert (grammar.decode_range(row, 5, 5) == ids[5:5]).all()


def test_fingerprints_by_string_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.concat(F.lit("d"), F.lpad("doc_id", 5, "0")).alias("doc_id"), "text", F.lit(1).alias("fingerprint"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", 2), ("d", None, 3)], docs.schema))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or ""), reverse=True)
    got = {r.doc_id: r for r in simhash.against_next(docs).collect()}
    assert len(got) == len(rows)
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, following = r.text or "", after.text or ""
        new = simhash.fingerprint(simhash.edited(text, following).encode())
        own, other = simhash.fingerprint(text.encode()), simhash.fingerprint(following.encode())
        x = got[r.doc_id]
        assert (x.n_chars, int(x.fingerprint, 16), int(x.edited_fingerprint, 16), x.near_next) == (len(text), own, new, simhash.likeness(own, other))
    assert Counter(r.n_chars for r in got.values()) == Counter(len(r.text or "") for r in rows)
