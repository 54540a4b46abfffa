"""The model and the threshold of operator 9 come from every labelled row."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import language


def test_fit_counts_every_labelled_row(spark):
    letters = "abcdefghijklmnopqrst"
    texts = [(i, f"the {letters[i % 20]}{letters[i // 20 % 20]}{letters[i // 400]}ing The", "en") for i in range(4000)]
    other = [(-1, "не там", "ru"), (-2, "unlabelled zzz", None), (-3, None, "de"), (-4, "12", "la")]
    model = language.fit(spark.createDataFrame([*texts, *other], "doc_id long, text string, lang string").repartition(7))
    assert model.langs == ["en", "la", "ru"]
    seen = Counter(p for _, text, _ in texts for w in text.lower().split() for p in language.pieces(w))
    kinds = len(seen) + len({p for w in ("не", "там") for p in language.pieces(w)}) + 1
    assert len(model.weights) == kinds - 1
    assert all(model.weights[p][0] == pytest.approx(np.log((n + 0.5) / (sum(seen.values()) + 0.5 * kinds))) for p, n in seen.items())


def test_usual_share_is_that_of_every_labelled_row(spark):
    # six of 3000 labelled rows, all outside a sample by hash, hold the quantile's low share of 0.2
    ids = spark.range(3000).withColumn("h", F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)))
    low = {r.id for r in ids.orderBy(F.desc("h"), "id").limit(6).collect()}
    rows = [(i, "the dog " + "собака ката ката " + "мышь пришла" if i in low else "the dog and that cat", "en") for i in range(3000)]
    probes = [(-1, "the dog собака пришла ту", None), (-2, "the собака пришла собака пришла собака пришла", None), (-3, "dog", None)]
    docs = spark.createDataFrame([*rows, *probes], "doc_id long, text string, lang string")
    model = language.fit(docs)
    score = {r.doc_id: r.score for r in language.identify(docs, model).collect()}
    usual = sorted(score[i] for i in range(3000))[int(language.USUAL * 2999)]
    assert 0.15 < usual < 0.25 and 0.25 < score[-1] < 0.35
    kept = {r.doc_id for r in language.in_a_language(docs, model).collect()}
    assert kept == {i for i, x in score.items() if x >= 0.5 * usual} == {*range(3000), -1, -3}
