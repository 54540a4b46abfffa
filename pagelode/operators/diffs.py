"""Revisions beside the one before, and the differences of two texts as hunks.

A hunk replaces the lines `removed` at place `at` of the old text by the lines `added`, which stand at
place `to` of the new one. Places count from 0; a null text is an empty one, and an empty text is one
empty line. Hunks of a text are divided by at least one line that both texts share.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pagelode.session import settled

#: Ranges that the ids of all revisions are cut into.
RANGES = 4096


def with_parent(revisions: DataFrame, **carried: str) -> DataFrame:
    """Adds parent_id, the id before rev_id on its page, and by other names columns of that revision.

    with_parent(revisions, before="text") adds the parent's text as before. Ids are cut into RANGES
    ranges, so that a page with a third of all revisions is dealt over its ranges: inside a range the
    row before is looked at, and the first of a range takes what the page's range before ends with.
    First revisions, and rows without a page or an id, have nulls. Of repeated ids one follows the other.
    Columns that the result adds are replaced.
    """
    added = {"parent_id": "rev_id"} | carried
    sources = {n: F.col(c).alias(f"p{i}") for i, (n, c) in enumerate(added.items())}
    rows = revisions.drop(*[n for n in added if n not in carried.values()])
    bounds = rows.agg(F.struct(F.min("rev_id").alias("low"), F.max("rev_id").alias("high")).alias("b")).scalar()
    share = (F.col("rev_id") - bounds["low"]).cast("double") / (bounds["high"] - bounds["low"] + 1).cast("double")
    key_ = "key_" + "_" * sum(c.lower().startswith("key_") for c in rows.columns)
    end_ = "end_" + "_" * sum(c.lower().startswith("end_") for c in rows.columns)
    page, range_, next_ = F.col(f"{key_}.page_id"), F.col(f"{key_}.range"), F.col("next" + end_)
    # the key is a struct, which is never null: joins add no filter on it, and both readers of the rows share one exchange
    ranged = rows.withColumn(key_, F.struct("page_id", F.floor(share * RANGES).alias("range")))
    # column by column, as a struct of them would be made before the exchange and move beside them
    inside = Window.partitionBy(key_).orderBy("rev_id")
    was = F.struct(*[F.lag(c).over(inside).alias(f"p{i}") for i, c in enumerate(added.values())])
    known = page.isNotNull() & F.col("rev_id").isNotNull() & F.lag("rev_id").over(inside).isNotNull()
    here = ranged.withColumn("here" + end_, F.when(known, was))
    # only ids are read to tell which ranges of a page have another one behind them; few have where revisions lie close
    held = ranged.where(page.isNotNull() & range_.isNotNull()).select(key_).distinct()
    followed = held.withColumn("next" + end_, F.lead(range_).over(Window.partitionBy(page).orderBy(range_))).where(next_.isNotNull())
    # by the key alone, in whose order the join leaves them: no further sort
    last = ranged.join(followed, key_).groupBy(key_).agg(F.max_by(F.struct(*sources.values()), "rev_id").alias(end_), F.max(next_).alias("next" + end_))
    ends = last.select(F.struct(page.alias("page_id"), next_.alias("range")).alias(key_), end_)
    both = here.join(ends, key_, "left").withColumn(end_, F.coalesce("here" + end_, end_))
    return both.select(*[page.alias(c) if c == "page_id" else F.col(c) for c in rows.columns if c not in added], *[F.col(f"{end_}.p{i}").alias(n) for i, n in enumerate(added)])


def lines(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")


@F.pandas_udf(ArrayType(IntegerType()))
def _rising(places: pd.Series) -> pd.Series:
    """Of each array of distinct numbers, the places of a longest rising chain."""

    def chain(values):
        ends, last, before = [], [], []
        for n, v in enumerate(values):
            at = bisect_left(ends, v)
            ends[at : at + 1], last[at : at + 1] = [v], [n]
            before.append(last[at - 1] if at else -1)
        out, n = [], last[-1] if last else -1
        while n >= 0:
            out.append(n)
            n = before[n]
        return out[::-1]

    return places.map(chain)


def _same_ahead(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    other = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), True).cast("int")
    return F.when(other == 0, n).otherwise(other - 1)


def _trimmed(pieces: DataFrame) -> DataFrame:
    """Pieces without the lines that both sides begin or end with; equal pieces go, and final ones stay as they are."""
    cut = lambda c, n: F.slice(c, n + 1, F.size(c) - n)
    a, b, same = F.col("a"), F.col("b"), F.col("same")
    # equal pieces are told by their lines: a filter on what is left would be pushed below, and all cuts made again for it
    ahead = pieces.where(a != b).withColumn("same", F.when(F.col("final"), 0).otherwise(_same_ahead(a, b)))
    rest = ahead.select("k", (F.col("at") + same).alias("at"), (F.col("to") + same).alias("to"), cut(a, same).alias("a"), cut(b, same).alias("b"), "final")
    behind = rest.withColumn("same", F.when(F.col("final"), 0).otherwise(_same_ahead(F.reverse(a), F.reverse(b))))
    keep = lambda c: F.slice(c, 1, F.size(c) - same)
    out = behind.select("k", "at", "to", keep(a).alias("a"), keep(b).alias("b"), "final")
    return out.withColumn("final", F.col("final") | (F.size("a") == 0) | (F.size("b") == 0))


def _anchors(pieces: DataFrame) -> DataFrame:
    """(k, at, to, chain): the lines that each side of a piece has once, in a longest order that both share."""
    each = pieces.select("k", "at", "to", F.size("a").alias("n"), F.posexplode(F.concat("a", "b")).alias("place", "line"))
    old = F.col("place") < F.col("n")
    once = each.groupBy("k", "at", "to", "line").agg(F.count_if(old).alias("n_a"), F.count_if(~old).alias("n_b"), F.min(F.when(old, F.col("place"))).alias("i"), F.min(F.when(~old, F.col("place") - F.col("n"))).alias("j"))
    met = once.where("n_a = 1 and n_b = 1").groupBy("k", "at", "to").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("met"))
    return met.withColumn("kept", _rising(F.col("met.j"))).select("k", "at", "to", F.transform("kept", lambda p: F.get("met", p)).alias("chain"))


def _split(open_: DataFrame) -> DataFrame:
    """Open pieces cut at their anchors; final ones have none, or lines on one side only."""
    # dealt once by what names a piece: its lines are counted and its anchors joined where it is. Nothing here is
    # null; as the filter says so, Spark adds none of its own to one reader and lets both read one exchange
    pieces = open_.where(" and ".join(f"{c} is not null" for c in open_.columns)).repartition("k", "at", "to")
    found = pieces.join(_anchors(pieces), ["k", "at", "to"], "left")
    ends = F.concat(F.coalesce("chain", F.array().cast("array<struct<i:int,j:int>>")), F.array(F.struct(F.size("a").alias("i"), F.size("b").alias("j"))))
    found = found.withColumn("ends", ends)
    begin = lambda p, c: F.when(p == 0, F.lit(0)).otherwise(F.get("ends", p - 1)[c] + 1)
    parts = F.transform("ends", lambda e, p: F.struct(begin(p, "i").alias("i"), begin(p, "j").alias("j"), e["i"].alias("i_end"), e["j"].alias("j_end")))
    part = found.select("k", "at", "to", "a", "b", F.col("chain").isNull().alias("final"), F.explode(parts).alias("p"))
    slice_ = lambda c, x: F.slice(c, F.col(f"p.{x}") + 1, F.col(f"p.{x}_end") - F.col(f"p.{x}"))
    return _trimmed(part.select("k", (F.col("at") + F.col("p.i")).alias("at"), (F.col("to") + F.col("p.j")).alias("to"), slice_("a", "i").alias("a"), slice_("b", "j").alias("b"), "final"))


def hunks(pairs: DataFrame, key: str = "rev_id", before: str = "before", after: str = "after") -> DataFrame:
    """(key, at, to, removed, added): the hunks that lead from one text to the other; none for equal texts.

    Patience anchors: lines that both texts have once meet by a grouped count, the longest chain of them
    that rises on both sides cuts the texts, and the pieces between are cut again by lines that are single
    inside them, until no piece has any. What two pieces begin and end with alike is no part of a hunk.
    Each round works on the pieces still open and is cut from its lineage; runs jobs when called. The key
    names one pair each; a null key has no hunks. Pairs that another step reads too are best settled before.
    """
    start = pairs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(0).alias("at"), F.lit(0).alias("to"), lines(before).alias("a"), lines(after).alias("b"), F.lit(False).alias("final"))
    state = settled(_trimmed(start))
    done = state.where("final")
    open_ = state.where("not final").drop("final")
    while not open_.isEmpty():
        state = settled(_split(open_))
        done = done.unionByName(state.where("final"))
        open_ = state.where("not final").drop("final")
    return done.select(F.col("k").alias(key), "at", "to", F.col("a").alias("removed"), F.col("b").alias("added"))


def applied(pairs: DataFrame, found: DataFrame, key: str = "rev_id", before: str = "before") -> DataFrame:
    """(key, text, line_change): the old texts of the pairs with their hunks applied, and how many lines they gain; null without hunks."""
    gain = (F.size("added") - F.size("removed")).cast("long")
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "removed", "added"))).alias("h"), F.sum(gain).alias("line_change"))
    rows = pairs.where(F.col(key).isNotNull()).select(key, F.col(before).alias("before")).join(lists, key, "left")
    rows = rows.select(key, "line_change", lines("before").alias("own"), F.coalesce("h", F.array().cast(lists.schema["h"].dataType)).alias("h"))
    end = lambda p: F.when(p <= 0, F.lit(0)).otherwise(F.get("h", p - 1)["at"] + F.size(F.get("h", p - 1)["removed"]))
    changed = F.flatten(F.transform("h", lambda x, p: F.concat(F.slice("own", end(p) + 1, x["at"] - end(p)), x["added"])))
    tail = F.slice("own", end(F.size("h")) + 1, F.size("own") - end(F.size("h")))
    return rows.select(key, F.array_join(F.concat(changed, tail), "\n").alias("text"), "line_change")


def unified(pairs: DataFrame, found: DataFrame, key: str = "rev_id", before: str = "before", title: str = "page", context: int = 3) -> DataFrame:
    """(key, diff): hunks written out with lines of context; those whose contexts touch are one. Equal texts have ''."""
    run = Window.partitionBy(key).orderBy("at")
    end = F.col("at") + F.size("removed")
    apart = F.col("at") - F.lag(end).over(run) > 2 * context
    blocks = found.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("block", F.sum("new").over(run))
    blocks = blocks.groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct("at", "to", "removed", "added"))).alias("h"))
    rows = blocks.join(pairs.select(key, lines(before).alias("own")), key)
    first, last = F.get("h", F.lit(0)), F.element_at("h", -1)
    low = F.greatest(F.lit(0), first["at"] - context)
    high = F.least(F.size("own"), last["at"] + F.size(last["removed"]) + context)
    rows = rows.withColumns({"low": low, "high": high, "shift": first["to"] - first["at"]})
    more = F.aggregate("h", F.lit(0), lambda n, x: n + F.size(x["added"]) - F.size(x["removed"]))
    spot = lambda s, n: F.when(n == 1, (s + 1).cast("string")).when(n == 0, F.concat(s.cast("string"), F.lit(",0"))).otherwise(F.concat_ws(",", s + 1, n))
    count = F.col("high") - F.col("low")
    head = F.concat(F.lit("@@ -"), spot(F.col("low"), count), F.lit(" +"), spot(F.col("low") + F.col("shift"), count + more), F.lit(" @@"))
    mark = lambda sign, xs: F.transform(xs, lambda x: F.concat(F.lit(sign), x))
    from_ = lambda p: F.when(p == 0, F.col("low")).otherwise(F.get("h", p - 1)["at"] + F.size(F.get("h", p - 1)["removed"]))
    body = F.flatten(F.transform("h", lambda x, p: F.concat(mark(" ", F.slice("own", from_(p) + 1, x["at"] - from_(p))), mark("-", x["removed"]), mark("+", x["added"]))))
    tail = mark(" ", F.slice("own", last["at"] + F.size(last["removed"]) + 1, F.col("high") - last["at"] - F.size(last["removed"])))
    written = rows.select(key, "block", F.array_join(F.concat(F.array(head), body, tail), "\n").alias("part"))
    whole = written.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    text = F.concat(F.lit(f"--- {title}\n+++ {title}\n"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n"))
    return pairs.where(F.col(key).isNotNull()).select(key).join(whole, key, "left").select(key, F.when(F.col("parts").isNull(), F.lit("")).otherwise(text).alias("diff"))
