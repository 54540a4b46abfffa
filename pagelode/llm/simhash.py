"""Document fingerprints: SimHash, and search within a Hamming radius by permuted block tables.

A text's terms are its windows of TERM consecutive words, lower-cased; with fewer words, the whole
sequence. Each term votes with its count, damped to 1 + log2, for the bits of its 64-bit hash; a
bit is set if more weight is for it than against it. A text without words has fingerprint 0.

Search: two fingerprints within radius r differ in at most r of b blocks, so in some choice of b - r
blocks they are equal. One table for each choice of blocks, keyed by their bits, therefore meets every
pair within the radius; blocks are chosen so that a key has more bits than the count of fingerprints
needs. Only distinct fingerprints are tabled: documents with equal ones are a class, named by its
smallest doc_id, and classes are linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.bpe import utf8
from pagelode.llm.common import Scratch
from pagelode.llm.hashing import WORDS, windows

BITS = 64
TERM = 2
#: Ids sampled for each range.
SAMPLED = 40


def fingerprint(text: bytes, term: int = TERM) -> int:
    words = text.lower().split()
    if not words:
        return 0
    kinds, counts = np.unique(windows(WORDS.of(words), min(term, len(words)), 3), return_counts=True)
    votes = np.unpackbits(kinds.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    weights = (1 + np.log2(counts)).astype(np.float32)
    return int.from_bytes(np.packbits(weights @ votes > weights.sum() / 2, bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    """The share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", term: int = TERM) -> DataFrame:
    """doc_id and fingerprint (long) of every document; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, term) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fingerprint long")


def blocks_for(n: int, radius: int) -> tuple[int, int]:
    """(blocks, kept): the fewest tables whose keys have two bits more than n needs."""
    if not 0 <= radius < 16:
        raise ValueError("radius must be 0 to 15")
    need = min(max(n, 2).bit_length() + 2, BITS // 2)
    blocks = radius + 1
    while (blocks - radius) * (BITS // blocks) < need:
        blocks += 1
    return blocks, blocks - radius


def near(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b, distance), a < b, of all distinct fingerprints within the radius. prints: fingerprint (long)."""
    own = Scratch(prints.sparkSession, "simhash").save(prints.select("fingerprint").where("fingerprint is not null").distinct(), "distinct")
    blocks, kept = blocks_for(own.count(), radius)
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def masked(choice: tuple[int, ...]) -> Column:
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in choice)
        return F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    keys = F.array(*[F.struct(F.lit(t).alias("t"), masked(c).alias("k")) for t, c in enumerate(combinations(range(blocks), kept))])
    tabled = own.select("fingerprint", F.inline(keys))
    a, b = tabled.withColumnRenamed("fingerprint", "a"), tabled.withColumnRenamed("fingerprint", "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = a.join(b, ["t", "k"]).where((F.col("a") < F.col("b")) & (distance <= radius))
    return met.select("a", "b", distance.alias("distance")).distinct()


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, class_id, distance: every document with its class, at 0, and every link of two classes by their ids, the larger as doc_id.

    prints: doc_id, fingerprint (long). Null fingerprints have no class.
    """
    scratch = Scratch(prints.sparkSession, "classes")
    prints = scratch.save(prints.select("doc_id", "fingerprint").where("fingerprint is not null"), "prints")
    own = scratch.save(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "classes")
    members = prints.join(own, "fingerprint").select("doc_id", "class_id", F.lit(0).alias("distance"))
    a, b = own.toDF("a", "class_a"), own.toDF("b", "class_b")
    links = near(own, radius).join(a, "a").join(b, "b")
    return members.unionByName(links.select(F.greatest("class_a", "class_b").alias("doc_id"), F.least("class_a", "class_b").alias("class_id"), "distance"))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first code points of the following document's, as many or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", term: int = TERM) -> DataFrame:
    """Every document's fingerprint held against its edited text's and the next document's, in descending id.

    Ids of any type with an order are cut into ranges of about equal counts by a sample of about SAMPLED ids
    a range, sorted in each, and read in one pass. What follows a range's last document is the next
    range's first, whose row is dealt to both; these are found from ids alone, one for each range. Null
    ids come last, in a range of their own; rows with equal ids are ordered by text and are in one range,
    as ids are meant to differ. Null text is empty. Other columns aren't read, whatever their names. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sampled = rows.select("doc_id").where("doc_id is not null").sample(min(1.0, SAMPLED * parts / max(1, rows.count())), seed=1)
    found = sorted(r["doc_id"] for r in sampled.collect())
    cuts = sorted({found[i * len(found) // parts] for i in range(1, parts)}, reverse=True) if found else []
    # range 0 has the largest ids; a null id is after all
    spots = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    at = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(spots, lambda c: F.col("doc_id") < c)))
    ranged = rows.withColumn("range", at)
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # the range whose last row is followed by this range's first
    before = {r: order[i - 1] for i, r in enumerate(order)}
    lookup = F.element_at(F.create_map(*[F.lit(x) for r in order for x in (r, before[r])]), F.col("range")) if order else F.lit(0)
    is_top = F.lit(False)
    if order:
        top = F.element_at(F.create_map(*[F.lit(x) for r in order if tops[r] is not None for x in (r, tops[r])]), F.col("range")) if any(v is not None for v in tops.values()) else F.lit(None)
        is_top = (F.col("doc_id") == top) | F.col("doc_id").isNull()
    dealt = ranged.select("doc_id", "text", F.explode(F.when(F.coalesce(is_top, F.lit(False)), F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("ahead")), F.struct(lookup.alias("r"), F.lit(1).alias("ahead")))).otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("ahead"))))).alias("d"))
    dealt = dealt.select("d.r", "d.ahead", "doc_id", "text").repartition(parts, "r").sortWithinPartitions("r", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(row: tuple, after: tuple) -> tuple:
            name, text, own = row
            changed = edited(text, after[1])
            new = fingerprint(changed.encode(), term)
            return name, len(text), hashlib.sha256(changed.encode()).hexdigest(), f"{own:016x}", f"{new:016x}", likeness(own, new), likeness(own, after[2])

        here = waiting = None
        closed = False
        for batch in batches:
            out = []
            for r, ahead, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if r != here:
                    here, waiting, closed = r, None, False
                if closed:
                    continue
                row = (name, text, fingerprint(text.encode(), term))
                if waiting is not None:
                    out.append(result(waiting, row))
                waiting, closed = row, bool(ahead)
            cols = list(zip(*out)) if out else [[]] * 7
            types = [batch.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
