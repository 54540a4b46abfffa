"""Signature times: comments are masked and a format's hits found once a text; odd texts stay as they were."""

import datetime as dt

from pyspark.sql import functions as F

from pagelode.functions import dates, scalars


def test_a_text_is_searched_once_for_each_format(spark, tmp_path):
    spark.createDataFrame([(1, "10:00, 1 May 2020 (UTC)")], "i int, text string").write.parquet(f"{tmp_path}/t")
    plan = dates.exploded(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<!--") == 2  # once to split, once to measure
    generate = next(x for x in plan.split("\n") if "Generate" in x)
    assert "regexp_extract_all" not in generate and plan.count("regexp_extract_all(") == 1 + len(dates.FORMATS)


def test_rows_and_columns_of_odd_texts(spark):
    texts = [
        None, "", "no time", "<!-- 10:00, 1 May 2020 (UTC)", "é<!-- x -->11:30, 2 May 2020 (UTC) 3 mai 2021 à 09:05 (CEST)😀11:30, 2 May 2020 (UTC)",
        "12:00, 31 February 2020 (UTC) 12:00, 1 Nonsense 2020 (UTC)", "08:00, 7. Dez. 2019 (CET) 08:00 7 dic 2019 (UTC) 08:00, March 7, 2019 (UTC)", "25:00, 1 May 2020 (UTC)", "٠٤:٠٩, 7 January 2018 (UTC)",
    ]
    rows = [(i, t, "kept", "old") for i, t in enumerate(texts)] + [(4, texts[4], "kept", "old"), (None, texts[4], None, None)]
    df = spark.createDataFrame(rows, "i int, body string, masked string, signature string")
    out = dates.exploded(df, "body")
    assert out.columns == ["i", "body", "masked", "signature"]
    plain = df.withColumn("signature", F.explode(dates.signatures(F.col("body"))))
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    got = sorted((r.i, r.signature.start, r.signature.ts, r.signature.language) for r in out.where("i is not null").collect())
    at = dt.datetime
    twice = [(4, 11, at(2020, 5, 2, 11, 30), "en"), (4, 35, at(2021, 5, 3, 9, 5), "fr"), (4, 61, at(2020, 5, 2, 11, 30), "en")]
    want = sorted(twice * 2) + [(6, 0, at(2019, 12, 7, 8, 0), "de"), (6, 26, at(2019, 12, 7, 8, 0), "es"), (6, 49, at(2019, 3, 7, 8, 0), "en"), (8, 0, at(2018, 1, 7, 4, 9), "en")]
    assert got == sorted(want)


def test_places_with_hits_at_hand(spark):
    df = spark.createDataFrame([(None,), ("",), ("ab12é345",), ("none",)], "t string").withColumn("h", scalars.matches(F.col("t"), r"\d+"))
    a, b = scalars.placed_matches(F.col("t"), r"\d+"), scalars.placed_matches(F.col("t"), r"\d+", F.col("h"))
    got = [(r.a, r.b) for r in df.select(a.alias("a"), b.alias("b")).collect()]
    assert all(x == y for x, y in got) and got[0][0] is None and [(x.start, x.text) for x in got[2][0]] == [(2, "12"), (5, "345")]
