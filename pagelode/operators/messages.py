"""Messages in the asked language or one that it falls back to, with plurals and arguments filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import plurals

LAST = "en"
#: {{PLURAL:count|forms}}; forms may hold a template or a link with bars of their own.
_PLURAL = r"(?i)\{\{PLURAL:((?:[^{}]|\{\{[^{}]*\}\})*)\}\}"
_BAR = r"\|(?![^{}]*\}\})(?![^\[\]]*\]\])"


def chains(languages: DataFrame, fallbacks: DataFrame, last: str = LAST) -> DataFrame:
    """(language, tried, place): each language (language), then what it falls back to in the order of fallbacks (language, fallback, rank), then the last one; each once."""
    own = languages.select("language").distinct()
    steps = own.select("language", F.col("language").alias("tried"), F.lit(-1).alias("place"))
    steps = steps.unionByName(own.join(fallbacks, "language").select("language", F.col("fallback").alias("tried"), F.col("rank").cast("int").alias("place")))
    steps = steps.unionByName(own.select("language", F.lit(last).alias("tried"), F.lit(2**31 - 1).alias("place")))
    return steps.groupBy("language", "tried").agg(F.min("place").alias("place"))


def texts(asked: DataFrame, bundles: DataFrame, fallbacks: DataFrame, last: str = LAST) -> DataFrame:
    """asked (key, language, ...) with template and tried, the language that has it; both null where none has.

    bundles: (language, key, text). Each pair of key and language is looked up once, however many rows ask
    for it; a null key or language finds nothing.
    """
    pairs = asked.select("key", "language").distinct()
    tried = pairs.join(chains(pairs, fallbacks, last), "language")
    found = tried.join(bundles.select(F.col("language").alias("tried"), "key", F.col("text").alias("template")), ["tried", "key"])
    first = found.groupBy("key", "language").agg(F.min(F.struct("place", "tried", "template")).alias("m")).select("key", "language", "m.template", "m.tried")
    return asked.join(first, ["key", "language"], "left")


def expanded(template: Column, language: Column, arguments: Column) -> Column:
    """A template with every plural and then $1, $2... filled in from an array of strings; null for a null template.

    A plural's count is a number or an argument; where it is neither, or there are fewer forms than the
    language has, the last form stands. A language without plural rules takes the last language's.
    """
    hits = F.regexp_extract_all(template, F.lit(_PLURAL), 1)

    def chosen(body: Column) -> Column:
        forms = F.split(body, _BAR)
        word = F.trim(F.get(forms, 0))
        count = F.when(word.startswith("$"), F.get(arguments, F.substring(word, 2, 9).try_cast("int") - 1)).otherwise(word).try_cast("long")
        own = F.coalesce(plurals.index(count, language), plurals.index(count, LAST))
        place = F.coalesce(F.least(own + 1, F.size(forms) - 1), F.size(forms) - 1)
        return F.when(F.size(forms) > 1, F.get(forms, place)).otherwise("")

    filled = F.array_join(F.flatten(F.zip_with(F.split(template, _PLURAL), F.transform(hits, chosen), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    places = F.when(F.size(arguments) > 0, F.sequence(F.size(arguments), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))  # $12 before $1
    return F.aggregate(places, filled, lambda text, i: F.replace(text, F.concat(F.lit("$"), i.cast("string")), F.coalesce(F.get(arguments, i - 1), F.lit("null"))))
