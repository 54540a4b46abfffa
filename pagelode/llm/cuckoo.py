r"""Exact dedup by a cuckoo-filter index of live digests.

Two texts are equal if they are once each run of `[\x20\x09-\x0D]` is one space. A text's digest is the
SHA-256 of that form; the first bytes of the digest choose its shard.

1. Inside each task of the first scan, equal digests become one row with the smallest id and a count, so
   a group of copies reaches its shard as a row for so many documents, however large it is.
2. A shard is a cuckoo filter: buckets of four 16-bit fingerprints, two buckets a digest, the second found
   from the first and the fingerprint. Rows come in order of id. A digest that neither bucket holds is
   new: it goes into the filter and its key is stored. A digest that a bucket holds is a hit. If an
   insertion finds no slot after KICKS moves, the shard gets twice the buckets and is filled again from
   its stored keys.
3. Only hits are looked at further. They meet the stored keys of their shard on the whole digest; a hit
   without a key is a false one of the filter, and becomes a key of its own.
4. Groups of two rows or more are verified on the texts: all texts of a digest must be one. Should they
   not be (a digest of few bits in tests), the group is split by text.

An Index is written tables, a generation each: insert() and delete() read the last one and write the next,
so that days of a corpus can come and go. A key holds how many live rows have it; when none is left, one of
its fingerprints is taken out of the filter.

Null text is empty. A null id is never the one that stays unless all ids of a group are null: keep_id is
then null and all rows of it stay. Rows repeated with one id and one text are all kept or all dropped.
Other columns aren't read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import Scratch, bit_map, in_map, lookup

SPACES = r"[\x20\x09-\x0D]+"
SLOTS, KICKS = 4, 200
#: Rows that a shard is planned for; it grows beyond that by itself.
SHARD_ROWS = 1024
#: Distinct digests that a task holds while it joins equal ones.
HELD = 100_000
_MASK = (1 << 64) - 1


class Cuckoo:
    """A cuckoo filter of digests given as 64-bit integers, which also keeps those for resizing."""

    def __init__(self, buckets: int = 64, table: bytes = b"", keys: bytes = b""):
        self.buckets = buckets
        self.table = array("H", table) if table else array("H", bytes(2 * SLOTS * buckets))
        self.keys = array("Q", keys)
        self.turn = 0

    def places(self, key: int) -> tuple[int, int, int]:
        """Fingerprint (never 0) and the two buckets."""
        mark = key >> 48 or 1
        first = (key * 0x9E3779B97F4A7C15 & _MASK) >> 20 & self.buckets - 1
        return mark, first, first ^ self.step(mark)

    def step(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 7) & self.buckets - 1

    def __contains__(self, key: int) -> bool:
        mark, a, b = self.places(key)
        t = self.table
        return mark in t[SLOTS * a : SLOTS * a + SLOTS] or mark in t[SLOTS * b : SLOTS * b + SLOTS]

    def insert(self, key: int) -> None:
        self.keys.append(key)
        while not self._put(key):
            self._refill(2 * self.buckets)

    def delete(self, key: int) -> None:
        """Takes one fingerprint of a key out that was inserted."""
        self.keys.remove(key)
        mark, *both = self.places(key)
        for bucket in both:
            for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.table[at] == mark:
                    self.table[at] = 0
                    return
        raise KeyError(key)

    def _put(self, key: int) -> bool:
        mark, at, other = self.places(key)
        for bucket in (at, other):
            if self._into(bucket, mark):
                return True
        for _ in range(KICKS):
            self.turn = self.turn * 5 + 1 & 0xFFFF
            slot = SLOTS * other + (self.turn >> 8) % SLOTS
            mark, self.table[slot] = self.table[slot], mark
            other ^= self.step(mark)
            if self._into(other, mark):
                return True
        return False

    def _into(self, bucket: int, mark: int) -> bool:
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.table[at]:
                self.table[at] = mark
                return True
        return False

    def _refill(self, buckets: int) -> None:
        """All stored keys into an empty table of so many buckets, or more if they don't fit."""
        while True:
            self.buckets, self.table = buckets, array("H", bytes(2 * SLOTS * buckets))
            # the key that found no slot is the last one stored and is put in by insert()
            if all(map(self._put, self.keys[:-1])):
                return
            buckets *= 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, digest) of every row: SHA-256 of the normalised text; bits cuts the digest short, for tests."""
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    return docs.select(F.col(id_col).alias("id"), sha.alias("sha")).withColumn("digest", F.substring("sha", 1, bits // 8))


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def joined(rows: DataFrame) -> DataFrame:
    """(digest, id, n): the rows (digest, id) of a task, those with equal digests joined; the smallest id."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        id_type = None

        def out() -> pa.RecordBatch:
            ids, counts = zip(*held.values())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(ids, id_type), pa.array(counts, pa.int64())], names=["digest", "id", "n"])

        for batch in batches:
            id_type = batch.column(1).type
            for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = held.get(d)
                if got is None:
                    held[d] = [i, 1]
                else:
                    got[1] += 1
                    if i is not None and (got[0] is None or i < got[0]):
                        got[0] = i
            if len(held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.select("digest", "id").mapInArrow(run, f"digest binary, id {kind}, n long")


@dataclass
class Index:
    """Tables of one generation: filters (shard, buckets, slots, stored), keys (digest, id, n) and members (digest, id)."""

    scratch: Scratch
    shards: int
    filters: DataFrame
    keys: DataFrame
    members: DataFrame
    generation: int = 0


def create(rows: DataFrame, shards: int) -> Index:
    """An index without digests, for rows (digest, id)."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    empty = lambda schema: spark.createDataFrame([], schema)
    return Index(Scratch(spark, "cuckoo"), shards, empty("shard int, buckets int, slots binary, stored binary"), empty(f"digest binary, id {kind}, n long"), empty(f"digest binary, id {kind}"))


#: What a sweep does with each digest.
INSERT, ADD, DELETE = "insert if new", "insert", "delete"


def sweep(filters: DataFrame, shards: int, rows: DataFrame, what: str) -> DataFrame:
    """Rows (digest, id, n) with hit, whether their shard's filter held them, and, with null hit, the filters of their shards afterwards.

    A task streams through its shards: first a shard's filter, then its rows in order of id, nulls last.
    It holds one filter at a time.
    """
    kind = rows.schema["id"].dataType.simpleString()
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    new = rows.select(shard.alias("shard"), "digest", "id", "n", F.lit(None).cast("int").alias("buckets"), F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("binary").alias("stored"))
    touched = filters.join(new.select("shard").distinct(), "shard", "left_semi")
    old = touched.select("shard", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("n"), "buckets", "slots", "stored")
    tasks = max(1, min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = old.unionByName(new).repartition(tasks, "shard").sortWithinPartitions("shard", F.desc_nulls_last("buckets"), F.asc_nulls_last("id"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, schema = None, Cuckoo(), None

        def last() -> list:
            return [at, None, None, None, own.buckets, own.table.tobytes(), own.keys.tobytes(), None]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for batch in batches:
            schema = batch.schema.append(pa.field("hit", pa.bool_()))
            out = []
            for name, d, i, n, buckets, slots, stored in zip(*(c.to_pylist() for c in batch.columns)):
                if name != at:
                    if at is not None:
                        out.append(last())
                    at, own = name, Cuckoo(buckets, slots, stored) if buckets else Cuckoo()
                if buckets:
                    continue
                key = _key(d)
                hit = key in own
                if what == ADD or what == INSERT and not hit:
                    own.insert(key)
                elif what == DELETE and hit:
                    own.delete(key)
                out.append([name, d, i, n, None, None, None, hit])
            if out:
                yield batch_of(out)
        if at is not None:
            yield batch_of([last()])

    return dealt.mapInArrow(run, f"shard int, digest binary, id {kind}, n long, buckets int, slots binary, stored binary, hit boolean")


def _filters(index: Index, swept: DataFrame) -> DataFrame:
    """The filters that a sweep has changed, and the others."""
    changed = swept.where("hit is null").select("shard", "buckets", "slots", "stored")
    return index.filters.join(changed.select("shard"), "shard", "left_anti").unionByName(changed)


def insert(index: Index, rows: DataFrame) -> Index:
    """The next generation, with rows (digest, id) as well."""
    s, g = index.scratch, index.generation + 1
    swept = s.save(sweep(index.filters, index.shards, joined(rows), INSERT), f"swept-{g}")
    stored = index.keys.unionByName(swept.where("not hit").select("digest", "id", "n"))
    # a digest hits at most once for each task of the first scan and HELD digests
    hits = s.save(swept.where("hit").groupBy("digest").agg(F.min("id").alias("hit_id"), F.sum("n").alias("hit_n")), f"hits-{g}")
    grown = stored.join(hits, "digest", "left").select("digest", F.least("id", "hit_id").alias("id"), (F.col("n") + F.coalesce("hit_n", F.lit(0))).alias("n"))
    false = s.save(hits.join(stored, "digest", "left_anti").toDF("digest", "id", "n"), f"false-{g}")
    keys = s.save(grown.unionByName(false), f"keys-{g}")
    out = Index(s, index.shards, s.save(_filters(index, swept), f"filters-{g}"), keys, index.members.unionByName(rows.select("digest", "id")), g)
    if not false.isEmpty():  # each key has a fingerprint of its own, so that it can be deleted
        late = s.save(sweep(out.filters, index.shards, false, ADD), f"late-{g}")
        out.filters = s.save(_filters(out, late), f"all-filters-{g}")
    s.drop(f"swept-{g}", f"hits-{g}")
    return out


def delete(index: Index, rows: DataFrame) -> Index:
    """The next generation without rows (digest, id); a key goes when no member is left, and its smallest id is found anew else."""
    s, g = index.scratch, index.generation + 1
    same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.id").eqNullSafe(F.col("b.id"))
    left = s.save(index.members.alias("a").join(rows.select("digest", "id").alias("b"), same, "left_anti"), f"members-{g}")
    touched = s.save(rows.select("digest").distinct().join(index.keys, "digest"), f"touched-{g}")
    alive = s.save(left.join(touched.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n")), f"alive-{g}")
    gone = touched.join(alive.select("digest"), "digest", "left_anti")
    swept = s.save(sweep(index.filters, index.shards, gone, DELETE), f"deleted-{g}")
    keys = s.save(index.keys.join(touched.select("digest"), "digest", "left_anti").unionByName(alive), f"keys-{g}")
    return Index(s, index.shards, s.save(_filters(index, swept), f"filters-{g}"), keys, left, g)


def seen(index: Index, rows: DataFrame) -> DataFrame:
    """rows (digest, ...) with keep_id and n of the live digest; null where none is. The filter spares the others the join."""
    probe = rows.select("digest", F.lit(None).cast(index.keys.schema["id"].dataType).alias("id"), F.lit(1).cast("long").alias("n")).dropDuplicates(["digest"])
    hits = index.scratch.save(sweep(index.filters, index.shards, probe, "look").where("hit").select("digest"), f"seen-{uuid.uuid4().hex}")
    live = index.keys.join(hits, "digest", "left_semi").select("digest", F.col("id").alias("keep_id"), "n")
    return lookup(rows, live, ["digest"], live.withColumnRenamed("n", "count"), "left")


def dedup(docs: DataFrame, bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.save(digests(docs, bits, id_col, text_col), "digests")
    index = insert(create(rows, rows.count() // SHARD_ROWS + 1), rows)
    several = scratch.save(index.keys.where("n > 1"), "several")
    # the texts of each group are held against each other: the least and the greatest must be one
    flags = scratch.save(bit_map(several, "digest"), "map")
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("own_text")).withColumn("sha", F.unhex(F.sha2("own_text", 256)))
    texts = texts.withColumn("digest", F.substring("sha", 1, bits // 8)).where(in_map(flags, F.col("digest")))
    ends = texts.groupBy("digest").agg(F.min("own_text").alias("a"), F.max("own_text").alias("b"))
    unlike = scratch.save(ends.where("a != b").select("digest"), "unlike")
    found = lookup(rows, several, ["digest"], several.withColumnRenamed("n", "count").select("digest", "count"), "left").toDF("digest", "doc_id", "sha", "keep_id", "group_size")
    if not unlike.isEmpty():
        found = found.join(unlike, "digest", "left_anti")
        own = texts.join(unlike, "digest", "left_semi")
        parts = own.groupBy("digest", "own_text").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(own.join(parts, ["digest", "own_text"]).select("digest", F.col("id").alias("doc_id"), "sha", "keep_id", "group_size"))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
