"""Plural rules and messages."""

import pytest
from pyspark.sql import functions as F

from pagelode.functions import plurals
from pagelode.operators import messages


def plain(rule, number):
    """Whether a rule holds, by its text evaluated on its own: operands as numbers, relations as comparisons."""
    text = str(number).lstrip("-")
    digits = text.partition(".")[2]
    of = {"n": float(text), "i": int(float(text)), "v": len(digits), "w": len(digits.rstrip("0")), "f": int(digits or 0), "t": int(digits.rstrip("0") or 0), "c": 0, "e": 0}

    def relation(words):
        left, sign, values = words.replace(" = ", "|=|").replace(" != ", "|!=|").split("|")
        operand, _, modulus = left.partition(" % ")
        x = of[operand] % int(modulus) if modulus else of[operand]
        held = any(x == int(v) if ".." not in v else x in range(int(v.split("..")[0]), int(v.split("..")[1]) + 1) for v in values.split(","))
        return held == (sign == "=")

    return any(all(map(relation, part.split(" and "))) for part in rule.split(" or "))


NUMBERS = [*map(str, [*range(0, 130), 200, 211, 1000, 1021, 20000, 100000, 1000000, 2000001, 3000000]), "0.0", "0.5", "1.0", "1.5", "2.00", "2.11", "3.12", "10.01", "0.1"]


def test_every_language_by_every_rule(spark):
    rows = spark.createDataFrame([(n,) for n in NUMBERS], "n string")
    languages = {own.split()[0]: texts for own, texts in plurals.RULES.items()}
    asked = rows.join(spark.createDataFrame([(x,) for x in languages], "language string"), F.lit(True))
    got = asked.select("n", "language", plurals.index(F.col("n"), F.col("language")).alias("form")).collect()
    assert len(got) == len(NUMBERS) * len(languages)
    for r in got:
        want = next((i for i, t in enumerate(languages[r.language]) if plain(t, r.n)), len(languages[r.language]))
        assert r.form == want, (r.language, r.n)


def test_known_forms(spark):
    def forms(language, *counts):
        rows = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, c long")
        return [r[0] for r in rows.orderBy("i").select(plurals.index(F.col("c"), language)).collect()]

    assert forms("en", 0, 1, 2, -1, None) == [1, 0, 1, 0, None] and forms("lt", 1, 2, 9, 11, 21) == [0, 1, 1, 3, 0]
    assert forms("fr", 0, 1, 2, 1_000_000, 2_000_001) == [0, 0, 2, 1, 2] and forms("gl", 1, 2, 1_000_000) == [0, 2, 1] and forms("ar", 0, 1, 2, 3, 11, 100) == [0, 1, 2, 3, 4, 5]
    assert forms("sr-ec", 1, 2, 5) == forms("isv-latn", 1, 2, 5) == [0, 1, 2] and forms("xx", 1) == [None]
    with pytest.raises(ValueError, match="not a plural relation"):
        plurals.condition("n is 1", plurals.operands(F.lit(1)))


def test_messages(spark):
    bundles = spark.createDataFrame([("en", "a", "{{PLURAL:$1|one|many}} $1$2 $10"), ("nb", "a", "nb"), ("no", "b", "no {{PLURAL:x|f|l}}{{PLURAL:2|f|l}}{{PLURAL:$1}}"), ("en", "b", "en")], "language string, key string, text string")
    edges = spark.createDataFrame([("nn", "no", 1), ("nn", "nb", 0)], "language string, fallback string, rank int")
    asked = spark.createDataFrame([(1, "a", "nn", ["1"]), (2, "b", "nn", ["7"]), (3, "a", "de", ["1", "x"]), (4, "c", "en", []), (5, None, "en", []), (6, "a", None, []), (7, "a", "en", None), (8, "a", "ru", ["5", "$1", *"3456789", "ten"])], "i int, key string, language string, args array<string>")
    got = {r.i: (r.tried, r.text) for r in messages.texts(asked, bundles, edges).select("i", "tried", messages.expanded(F.col("template"), F.col("language"), F.col("args")).alias("text")).collect()}
    assert got[1] == ("nb", "nb") and got[2] == ("no", "no ll") and got[3] == ("en", "one 1x $10".replace("$10", "10")) and got[4] == got[5] == got[6] == (None, None)
    assert got[8][1].endswith("ten")
    assert messages.texts(asked.limit(0), bundles, edges).count() == 0
