"""Quality rules as a short-circuit cascade. DataFrame operations only.

Each rule is a boolean expression that is true where it rejects. On a bounded sample every rule's
cost and the rows it rejects are measured, and the rules then run by rejection per cost, highest first,
each rated on what those before it leave: a later rule is not evaluated for a row that an earlier one has rejected. A row is
kept if no rule rejects it, so the verdict doesn't depend on the order or on the sample.

Null and blank texts have no words. A text is read whole, and no rule groups rows, so repeated rows
have equal results. Input columns of the names given here are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import SPACE, Scratch, free, words_of

#: Rows, about, that the order of the rules is fitted on.
SAMPLE_ROWS = 2000
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule that is true where it rejects; it gets the text (null for rows rejected before) and may read measures().

    passes: how often it reads the text; 0 for a rule on measures alone.
    """

    name: str
    rejects: Callable[[Column], Column]
    passes: int = 1


def worded_lines(text: Column) -> Column:
    """A text's lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Repeated windows: hashes of 1, 2, 4 and 8 words are combined, so a window costs three steps. If
    all windows differ the answer is 0. Otherwise (hash, place) pairs are sorted, equal neighbours
    mark the repeated windows, and each of these adds its words up to the next one's start.
    Intermediate columns are used more than once, which keeps Spark from evaluating them again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w_, lines_, h_, p_, at_ = free(docs, "words_", "lines_", "hashes_", "pairs_", "places_")
    df = docs.withColumn(w_, words_of(F.col(text_col))).withColumn(lines_, worded_lines(text))
    df = df.withColumns(
        {
            "n_words": F.size(w_).cast("long"),
            "word_chars": F.length(text).cast("long") - F.regexp_count(text, F.lit(SPACE)),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
            h_: F.transform(w_, lambda w: F.xxhash64(w)),
        }
    ).drop(w_, lines_)
    step = 1
    while step < WINDOW:
        n = F.greatest(F.size(h_) - step, F.lit(0))
        df = df.withColumn(h_, F.zip_with(F.slice(h_, 1, n), F.slice(h_, step + 1, n), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    pair = "array<struct<h:bigint,i:int>>"
    pairs = F.sort_array(F.transform(h_, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(p_, F.when(F.size(F.array_distinct(h_)) < F.size(h_), pairs).otherwise(F.array().cast(pair)))

    def place(p: Column, i: Column) -> Column:
        return F.when((F.get(p_, i - 1)["h"] == p["h"]) | (F.get(p_, i + 1)["h"] == p["h"]), p["i"])

    df = df.withColumn(at_, F.sort_array(F.filter(F.transform(p_, place), lambda i: i.isNotNull())))
    spans = F.transform(at_, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at_, i + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", total).drop(h_, p_, at_)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _share(pattern: str, of: str, most: float) -> Callable[[Column], Column]:
    """Rejects where matches of pattern exceed a share of matches of another."""

    def rejects(text: Column) -> Column:
        return F.coalesce(F.regexp_count(text, F.lit(pattern)) > most * F.regexp_count(text, F.lit(of)), F.lit(False))

    return rejects


#: The rules that a document which passes the base must pass too.
RULES = (
    Rule("word length", lambda t: (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")), 0),
    Rule("symbols", lambda t: F.col("n_symbols") > 0.5 * F.col("n_words"), 0),
    Rule("repeated lines", lambda t: 10 * F.col("n_dup_lines") > 3 * F.size(worded_lines(t))),
    Rule("digits", _share(r"\p{N}", r"\p{L}", 0.5), 2),
    Rule("capitals", _share(r"\p{Lu}", r"\p{L}", 0.6), 2),
)


def fit_order(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", rejected: Column | None = None) -> list[Rule]:
    """The rules by rejection per cost as estimated on a sample of the documents that pass what comes before them.

    The sample is a share of the rows, chosen so that about SAMPLE_ROWS come, less those already rejected.
    A rule's cost on a row is one, and the text's characters for each time that it reads the text; a clock
    would give another order each time. The first rule has the most rejections per cost; the next ones
    are rated, rejections and cost, on the rows that the rules before them leave. Rules without a
    rejection come last, the cheaper first; ties go by name. An empty table leaves the order by cost.
    """
    total = docs.count()
    share = min(1.0, SAMPLE_ROWS / total) if total else 1.0
    sample = Scratch(docs.sparkSession, "quality").save(measures(docs.select(text_col).sample(share, seed=1), text_col), "sample")
    if rejected is not None:  # on the written table: a filter above measures() would evaluate them over and over
        sample = sample.where(~F.coalesce(rejected, F.lit(False)))
    flags = [rule.rejects(F.col(text_col)).cast("int").alias(f"r{i}") for i, rule in enumerate(rules)]
    chars = F.coalesce(F.char_length(text_col), F.lit(0)).alias("chars")
    # a row for each set of rules that reject, at most as many as the sample has
    seen = sample.select(chars, *flags).groupBy(*[f"r{i}" for i in range(len(rules))]).agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    order: list[int] = []
    while len(order) < len(rules):
        open_ = [r for r in seen if not any(r[k] for k in order)]
        n, size = sum(r["n"] for r in open_), sum(r["chars"] for r in open_)

        def rate(k: int) -> tuple[float, int, str]:
            cost = n + rules[k].passes * size + 1 + rules[k].passes  # noqa: B023  used in this turn
            return -sum(r["n"] for r in open_ if r[k]) / cost, cost, rules[k].name  # noqa: B023

        order.append(min((k for k in range(len(rules)) if k not in order), key=rate))
    return [rules[k] for k in order]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rejected: Column | None = None, text_col: str = "text") -> DataFrame:
    """The input with its measures and kept: true where neither rejected nor any rule holds. rejected: evaluated before the rules."""
    verdict = F.when(rejected if rejected is not None else F.lit(False), F.lit(False))
    for rule in fit_order(docs, rules, text_col, rejected):
        verdict = verdict.when(rule.rejects(F.col(text_col)), F.lit(False))
    return measures(docs, text_col).withColumn("kept", verdict.otherwise(F.lit(True)))
