"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Each document has a 36-bit key, the first nine hexadecimal digits of the md5 of its id. For a
budget, a source takes the documents whose key lies below a threshold. The threshold is found
without sorting documents: word counts are summed by source and by the key's first three digits,
the budget falls into one of these 4096 buckets, and only the documents of that bucket are summed
again by the next three digits, then by the last three. A larger budget has a larger threshold, so
mixes of growing budgets are nested.

A source whose target is T and whose documents have S words takes every document floor(T / S)
times, and those below the threshold for the rest once more.

Null text counts as empty; a null source is a source of its own, the last; documents with equal ids
have one key and are taken alike; without any words all targets are 0; an empty table gives none.
Input columns besides the three named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import Scratch, free, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
DIGITS = 3
LEVELS = 3


def doc_key(name: Column) -> Column:
    return F.substring(F.md5(F.coalesce(name.cast("string"), F.lit("null"))), 1, DIGITS * LEVELS)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key) of all documents."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        doc_key(F.col(id_col)).alias("key"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in order of code point, null last, have the weights in turn, repeating. They share
    ``share`` times all words by weight; where that is more than ``most`` times a source's own, the
    excess goes to the others by weight until none is above. With sources ordered by cap / weight,
    those that reach their cap come first, so one running sum gives the level of the others.
    """
    if not 0 < share <= most:
        raise ValueError("share must be above 0 and at most most")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy("ratio", "rank")
    levels = (
        ranked.withColumn("weight", w)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(Window.partitionBy()) - F.col("before")) / F.col("open"))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("final", F.min(F.when(~F.col("capped"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy()))
    )
    return levels.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final.level")).alias("target"))


def thresholds(keys: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the keys below it have at most the budget's words and one bucket more would exceed it.

    budgets: (source, budget), one row for each source. A budget that no boundary meets has the
    threshold "g", above all keys.
    """
    found = budgets.select("source", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("whole"))
    for level in range(LEVELS):
        n = DIGITS * level
        inside = keys.alias("k").join(
            found.alias("f"), F.col("k.source").eqNullSafe(F.col("f.source")) & (F.substring("k.key", 1, n) == F.col("f.prefix")) & ~F.col("f.whole")
        )
        sums = inside.groupBy(F.col("k.source").alias("source"), F.substring("k.key", n + 1, DIGITS).alias("bucket")).agg(F.sum("k.size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        end = F.col("below") + F.col("to")
        over = (
            sums.withColumn("to", F.sum("words").over(run)).alias("s")
            .join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
            .select(F.col("s.source").alias("source"), "bucket", (end - F.col("words")).alias("start"), end.alias("end"), "budget", "prefix")
        )
        first = over.where(F.col("end") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", "start", "prefix")).alias("b"))
        found = (
            budgets.alias("a").join(first.alias("o"), F.col("a.source").eqNullSafe(F.col("o.source")), "left")
            .select(
                F.col("a.source").alias("source"), F.col("a.budget").alias("budget"),
                F.concat(F.coalesce("b.prefix", F.lit("")), F.coalesce("b.bucket", F.lit("g"))).alias("prefix"),
                F.coalesce("b.start", F.lit(0)).cast("long").alias("below"), F.col("b").isNull().alias("whole"),
            )
        )
    return found.select("source", F.when(F.col("whole"), F.lit("g")).otherwise(F.col("prefix")).alias("threshold"))


def plan(keys: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, whole, threshold), one row for each source of keyed()'s rows."""
    sizes = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = scratch.save(targets(sizes, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = thresholds(keys.where("size > 0"), goal.select("source", "budget"))
    out = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")))
    # a source that stops at its most takes nothing once more
    threshold = F.when(F.col("whole") < most, F.col("threshold")).otherwise(F.lit(""))
    return scratch.save(out.select(F.col("g.source").alias("source"), "source_size", "target", "whole", threshold.alias("threshold")), "plan")


def times() -> Column:
    """How often a document is taken, from its key and its source's plan."""
    return F.col("whole") + (F.col("key") < F.col("threshold")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, times (how often it is taken), taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keys = scratch.save(keyed(docs, id_col, text_col, source_col), "keys")
    rows = keys.alias("k").join(plan(keys, scratch, weights, share, most).alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")))
    return rows.select("doc_id", "size", F.col("k.source").alias("source"), "source_size", "target", times().alias("times"), (F.col("size") * times()).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input's rows as often as the mix takes them."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keys = scratch.save(keyed(docs, id_col, text_col, source_col), "keys")
    own, way, copy = free(docs, "plan_source", "plan", "copy")
    sources = plan(keys, scratch, weights, share, most).select(F.col("source").alias(own), F.struct("whole", "threshold").alias(way))
    rows = docs.join(sources, F.col(source_col).eqNullSafe(F.col(own)))
    often = F.col(way)["whole"] + (doc_key(F.col(id_col)) < F.col(way)["threshold"]).cast("long")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(True), often.cast("int")))).drop(own, way, copy)
