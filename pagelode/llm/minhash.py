"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star-shaped candidates.

A document's set is its distinct shingles of ``words`` consecutive words, A-Z lower-cased; with fewer
words the whole sequence is one shingle. Two documents are linked if the Jaccard similarity of their
sets is at least ``percent`` in 100; a component's id is its smallest document id.

1. One hash of each shingle gives both its bin and its value; a bin's value is its least hash, and an
   empty bin copies from the first non-empty one in a pseudo-random order of its own.
2. Documents with equal sets fall into one class; only its smallest id goes on.
3. Bands of the bins are bucket keys. In a bucket every member is paired with one hub, the member that
   shares most buckets with others, so a bucket of n gives n - 1 pairs.
4. Pairs are confirmed on the texts' full sets, and confirmed links give components.
5. A bucket that still holds several components is refined into smaller ones, again by stars. Let h be
   its hub's set, x and y two members that are linked but not in one component, and c = (100 - percent) /
   (100 + percent). One of them, say x, is not linked with h: e = |x ^ h| - c (|x| + |h|) is above 0.
   Sizes then give that x and y share at least (e - (1 - c) (|h| - |y|)) / 2 shingles that h lacks, or, if
   y is so small that this is not above 0, at least e / (1 - c) of h's shingles are lacking in both. So
   each member is posted under the rarest shingles by which it differs from the hub, as many as a prefix
   filter for these overlaps needs, and the members under one such shingle are a bucket of the next
   round, which has more hubs. An edit that no other member has gives no bucket. Members are only ever paired with hubs, and
   hubs leave their buckets, so the rounds end; every pair that shares a bucket and could join two
   components is tested or ruled out.

With 24 bands of 5 bins a pair at 0.85 shares no bucket with probability 8e-7.

Empty sets (null, empty and blank texts) are linked with nothing. A null id is linked with nothing.
Rows with equal ids are one node with the least of their texts. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.bpe import utf8
from pagelode.llm.common import Scratch, lookup
from pagelode.llm.components import components
from pagelode.llm.hashing import WORDS, mix, only, windows

BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
#: So many hubs, doubled from round to round, have the buckets of the rounds after the first.
HUBS = 4

_PLACES = np.arange(BINS, dtype=np.uint64)
#: For each bin the order in which it looks at all bins when it is empty.
_ORDER = np.argsort(mix(_PLACES[:, None] * np.uint64(1 << 20) + _PLACES[None, :] + np.uint64(77)), axis=1)
_EDGES = np.array([-(-(i << 64) // BINS) for i in range(1, BINS)], np.uint64)
_BAND = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1_000_003))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's set."""
    found = text.lower().split()
    hashes = WORDS.of(found)
    return np.unique(windows(hashes, min(words, len(found)))) if found else np.zeros(0, np.uint64)


def band_keys(members: np.ndarray) -> np.ndarray:
    """The bucket keys of a non-empty set of sorted hashes."""
    starts = np.concatenate([[0], np.searchsorted(members, _EDGES)])
    full = np.diff(np.append(starts, len(members))) > 0
    bins = members[np.minimum(starts, len(members) - 1)]
    from_ = _ORDER[np.arange(BINS), np.argmax(full[_ORDER], axis=1)]
    bins = np.where(full, bins, bins[from_]).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bins[:, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_digest and keys of every document; digest and keys are null for an empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in batches:
            n, digest, keys = [], [], []
            for text in utf8(batch.column(1)):
                members = shingles(text, words)
                n.append(len(members))
                digest.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                keys.append(band_keys(members) if len(members) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_digest", "keys"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_digest binary, keys array<long>")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs with x, the text of node, and y, the text of hub. texts: (node, text)."""
    first = pairs.join(texts.toDF("node", "x"), "node")
    return lookup(first, texts.toDF("hub", "y"), ["hub"], pairs.groupBy("hub").count())


def word_set(text: bytes, words: int) -> set:
    found = text.lower().split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return set(zip(*[found[i:] for i in range(words)]))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The label and hub_label of those pairs (node, hub, ...) whose full sets reach the similarity."""
    kind = pairs.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, set()
        for batch in batches:
            keep = []
            for name, x, y in zip(batch.column(2).to_pylist(), utf8(batch.column(3)), utf8(batch.column(4))):
                if name != last:
                    last, hub = name, word_set(y, words)
                own = word_set(x, words)
                both = len(own & hub)
                keep.append(100 * both >= percent * (len(own) + len(hub) - both))
            found = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found)], names=["a", "b"])

    return with_texts(pairs, texts).select("label", "hub_label", "hub", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def own_shingles(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, hub, n, gone, total, prefix, shingle) for pairs (node, hub, n, least).

    The shingles that a node has and its hub lacks (gone false) and those that it lacks (gone true): how
    many they are and how many of the rarest to post. least: the smallest set in the pair's buckets.
    """
    kind = pairs.schema["node"].dataType.simpleString()
    all_, rest = 100 + percent, 100 - percent

    def prefixes(x: int, h: int, lacking: int, missing: int, least: int) -> tuple[int, int]:
        above = all_ * (lacking + missing) - rest * (x + h)
        if above <= 0:  # linked with the hub
            return lacking, missing if x < h else 0
        shared = -(-(above - 2 * percent * (h - max(least, -(-percent * x // 100)))) // (2 * all_))
        if shared >= 1:
            return lacking - shared + 1, 0
        return lacking, missing - -(-above // (2 * percent)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows, found = [], []
            names = batch.column(1).to_pylist()
            for i, (name, least, x, y) in enumerate(zip(names, batch.column(3).to_pylist(), utf8(batch.column(4)), utf8(batch.column(5)))):
                if name != last:
                    last, hub = name, shingles(y, words)
                own = shingles(x, words)
                sides = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
                for gone, (side, prefix) in enumerate(zip(sides, prefixes(len(own), len(hub), len(sides[0]), len(sides[1]), least))):
                    if prefix > 0 and len(side):
                        found.append(side)
                        rows.append((i, gone, len(side), prefix))
            sizes = [r[2] for r in rows]
            at, gone, total, prefix = (np.repeat(np.array([r[k] for r in rows], np.int64), sizes) for k in range(4))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            cols = [*[batch.column(k).take(pa.array(at)) for k in range(3)], pa.array(gone == 1), pa.array(total, pa.int32()), pa.array(prefix, pa.int32()), pa.array(flat.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "hub", "n", "gone", "total", "prefix", "shingle"])

    return with_texts(pairs, texts).select("node", "hub", "n", "least", "x", "y").mapInArrow(run, f"node {kind}, hub {kind}, n long, gone boolean, total int, prefix int, shingle long")


def refined(left: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(key, node, n): the smaller buckets of members left (node, hub, n, least) that may be linked with each other."""
    posts = scratch.save(own_shingles(left, texts, words, percent), f"{name}-shingles")
    shared = scratch.save(posts.groupBy("hub", "shingle").count().where("count > 1"), f"{name}-shared")
    found = lookup(posts, shared, ["hub", "shingle"], shared)
    place = Window.partitionBy("node", "hub", "gone")
    rank = F.row_number().over(place.orderBy("count", "shingle")) + F.col("total") - F.count("*").over(place)
    kept = found.withColumn("rank", rank).where("rank <= prefix").select(F.xxhash64("hub", "shingle").alias("key"), "node", "n")
    kept = scratch.save(kept.distinct(), f"{name}-posts")
    scratch.drop(f"{name}-shingles", f"{name}-shared")
    return kept


def relabelled(labels: DataFrame | None, merged: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) after labels were merged; merged: (label, root)."""
    if labels is None:
        return scratch.save(merged.toDF("node", "label"), name)
    old = lookup(labels, merged, ["label"], how="left").select("node", F.coalesce("root", "label").alias("label"))
    new = merged.join(labels.select(F.col("node").alias("label")), "label", "left_anti").toDF("node", "label")
    return scratch.save(old.unionByName(new), name)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every document."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.save(signatures(docs, words, id_col, text_col), "signatures")
    classes = (
        signed.where("set_digest is not null and doc_id is not null").groupBy("set_digest")
        .agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n"), F.count("*").alias("count"))
    )
    classes = scratch.save(classes, "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "node", "n")
    shared = scratch.save(keyed.groupBy("key").count().where("count > 1"), "shared")
    rows = scratch.save(lookup(keyed, shared, ["key"], shared).drop("count"), "rows-0")
    own = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    texts = scratch.save(own.join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    labels = None

    def named(found: DataFrame) -> DataFrame:
        """found with the label of its nodes; a node without one is its own."""
        if labels is None:
            return found.withColumn("label", F.col("node"))
        return found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    i = 0
    while not rows.isEmpty():
        # the hub of a bucket is the member that shares most buckets with others
        wide = scratch.save(rows.groupBy("key").count().where("count > 1"), f"sizes-{i}")
        rows = scratch.save(lookup(rows, wide, ["key"], wide), f"sized-{i}")
        central = rows.groupBy("node").agg(F.sum("count").alias("weight"))
        known = scratch.save(named(rows.drop("count").join(central, "node")), f"named-{i}")
        own = F.struct("node", "n", "label")
        central = F.min_by(own, F.struct(-F.col("weight"), F.col("node")))
        buckets = known.groupBy("key").agg(F.count("*").alias("count"), F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("least"), F.array(central).alias("hubs"))
        buckets = buckets.where("x != y").drop("x", "y")
        if i:  # what is left is little: ever more hubs for few rounds
            slot = F.pmod(F.xxhash64("label", "key"), F.lit(HUBS << i))  # a hub for each of a few components
            more = known.groupBy("key", slot.alias("slot")).agg(F.min(own).alias("h")).groupBy("key").agg(F.collect_list("h").alias("more"))
            buckets = buckets.join(more, "key").select("key", "count", "least", F.array_union("hubs", "more").alias("hubs"))
        buckets = scratch.save(buckets, f"buckets-{i}")
        members = scratch.save(lookup(known.drop("weight"), buckets, ["key"], buckets), f"members-{i}")
        met = members.select("node", "n", "label", F.explode("hubs").alias("h")).select("node", "n", "label", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label"))
        able = met.where(f"label != hub_label and 100 * hub_n >= {percent} * n and 100 * n >= {percent} * hub_n").select("node", "hub", "label", "hub_label").distinct()
        links = scratch.save(confirmed(scratch.save(able, f"pairs-{i}"), texts, words, percent), f"links-{i}")
        # hubs are done with; a bucket is too if the others are of one component
        open_ = members.where(~F.exists("hubs", lambda h: h["node"] == F.col("node"))).select("key", "node", "n", "label", F.col("hubs")[0]["node"].alias("hub"), "least")
        if not links.isEmpty():
            merged = components(links, scratch, f"components-{i}").toDF("label", "root")
            labels = relabelled(labels, merged, scratch, f"labels-{i}")
            open_ = scratch.save(named(open_.drop("label")), f"renamed-{i}")
        split = open_.groupBy("key").agg(F.count("*").alias("count"), F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key", "count")
        split = scratch.save(split, f"split-{i}")
        open_ = lookup(open_, split, ["key"], split)
        left = open_.groupBy("node", "hub").agg(F.first("n").alias("n"), F.min("least").alias("least"))
        left = scratch.save(left, f"left-{i}")
        if left.isEmpty():
            break
        scratch.drop(*[f"{name}-{i}" for name in ("rows", "sizes", "sized", "named", "buckets", "members", "pairs", "renamed", "split")])
        rows = refined(left, texts, words, percent, scratch, f"refined-{i}")
        i += 1
    component = F.col("node") if labels is None else F.coalesce("label", "node")
    found = (classes if labels is None else classes.join(labels, "node", "left")).select("set_digest", component.alias("component"))
    whole = signed.where("set_digest is not null").drop("keys")
    out = lookup(whole, found, ["set_digest"], classes, "left").unionByName(signed.where("set_digest is null").drop("keys"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without those that a document of a smaller id stands for; of equal rows one stays."""
    found = near_duplicates(docs, words, percent, id_col, text_col)
    gone = found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").dropDuplicates([id_col, text_col]).select(*docs.columns)
