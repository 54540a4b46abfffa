r"""Spelling variants: a rare-first prefix filter on positional bigrams.

A run is a maximal `[A-Za-zÀ-ÿ]+` of a text, lower-cased in A-Z only. Two words are near if they
differ by exactly one inserted, deleted or replaced code point.

1. Each task counts its runs and adds them up before the shuffle, so a very frequent word is one row a task.
2. Bigrams of all words are counted, and each word's bigrams are put in one global order, the rarest
   first, equal counts by the bigram. One edit destroys at most two bigrams of a word, so two near words
   share one of the three rarest bigrams of both; further places of the third one count as well, so that
   repeated bigrams lose nothing.
3. The shared bigram lies left or right of the edit. If left, both words are equal up to its end, at the
   same place; if right, they are equal from its start, at places that differ by the lengths' difference.
   A word is therefore posted under the start of the word up to each such bigram and under its end from
   there, and only words with one posting in common and lengths apart by 1 at most meet.
4. Words that meet are compared by a bitmap of their letters and verified by their edit distance, both
   inside the join, so that no other pair leaves it.
5. A word's form is the near word of the largest count; roots are found by doubling steps along the
   forms, which rise by a factor each, so that the rounds are few.

Null text has no runs. A null id is written as nothing before the colon when occurrences are drawn.
Repeated rows count again. Words are ordered by code points. Other columns aren't read, whatever their
names. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.bpe import utf8
from pagelode.llm.common import Scratch, lookup

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
GRAM, EDITS = 2, 1


def altered(run: str, h: int, every: int) -> str:
    """The run without its code point h % length if every divides h."""
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the occurrences of all runs; those whose crc32 of id:run is a multiple of every lose a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = Counter(RUN.findall(text.lower().decode()))  # lower() of bytes changes A-Z only
                base = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), base)
                    held[altered(word, h, every) if not h % every else word] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams(word: Column) -> Column:
    """The positional bigrams of a word: array<struct<gram, pos>>."""
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - GRAM + 1), lambda i: F.struct(F.substr(word, i, F.lit(GRAM)).alias("gram"), i.alias("pos")))


def prefixes(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, gram, pos): the places of each word's rarest bigrams that a near word must share."""
    places = scratch.save(words.select("word", F.inline(grams(F.col("word")))), "grams")
    frequency = scratch.save(places.groupBy("gram").count(), "gram-counts")
    ranked = lookup(places, frequency.select("gram", F.col("count").alias("c")), ["gram"], frequency)
    own = ranked.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("c", "gram", "pos"))).alias("own"))
    last = F.get("own", F.least(F.lit(GRAM * EDITS), F.size("own") - 1))
    kept = F.filter("own", lambda g: F.struct(g["c"], g["gram"]) <= F.struct(last["c"], last["gram"]))
    return own.select("word", F.explode(kept).alias("g")).select("word", "g.gram", "g.pos")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of distinct words (word) within one edit, a before b; words have a bigram at least."""
    at = prefixes(words.select("word"), scratch)
    size = F.char_length("word")
    left = at.select("word", F.lit("<").alias("side"), F.substr("word", F.lit(1), F.col("pos") + GRAM - 1).alias("part"))
    right = at.select("word", F.lit(">").alias("side"), F.substr("word", F.col("pos"), size).alias("part"))
    # a word is posted under its own length, and as the longer one of two under the length below
    lengths = F.array(F.struct(size.alias("size"), F.lit(False).alias("longer")), F.struct((size - 1).alias("size"), F.lit(True).alias("longer")))
    posts = left.unionByName(right).distinct().select("word", letters(F.col("word")).alias("map"), "side", "part", F.inline(lengths))
    posts = scratch.save(posts.select(F.xxhash64("side", "part", "size").alias("key"), "longer", "word", "map"), "posts")
    shared = scratch.save(posts.groupBy("key").count().where("count > 1"), "post-counts")
    met = scratch.save(posts.join(shared.select("key"), "key"), "met")
    x, y = met.where("not longer").alias("x"), met.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("y.longer") | (F.col("x.word") < F.col("y.word")))
    close = (F.bit_count(F.col("x.map").bitwiseXOR(F.col("y.map"))) <= 2 * EDITS) & (F.levenshtein(F.col("x.word"), F.col("y.word"), EDITS) == EDITS)
    found = x.join(y, same & close).select(F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("b"))
    return scratch.save(found.distinct(), "pairs")


def letters(word: Column) -> Column:
    """For each of 64 bits whether an odd count of code points falls on it: one edit changes two bits at most."""
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(one(c)))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for rows (word, form) whose forms lead to an end: each round goes twice as far."""
    at = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0")
    for i in range(1, 64):
        step = lookup(at, at.toDF("root", "next"), ["root"], at.groupBy("root").count(), "left")
        step = scratch.save(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{i}")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at
    raise RuntimeError("roots: forms run in a circle")


def variants(docs: DataFrame, least_chars: int = 6, least_n: int = 5, factor: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of enough code points and occurrences.

    A form is a near word with at least factor times the word's occurrences; factor must be above 1, so
    that forms can't run in a circle.
    """
    if factor < 2 or least_chars < GRAM:
        raise ValueError("factor must be 2 or more, least_chars 2 or more")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = counts(docs, every, id_col, text_col).where((F.col("n") >= least_n) & (F.char_length("word") >= least_chars))
    words = scratch.save(words, "words")
    pairs = near_pairs(words, scratch)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.toDF("b", "b_n"), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("top"))
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("top.less"))
    is_form = F.col("form_n") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top.form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    rows = scratch.save(rows, "forms")
    ends = roots(rows.where("form is not null"), scratch)
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
