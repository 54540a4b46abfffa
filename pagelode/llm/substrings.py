"""Substring dedup on a compacted De Bruijn graph of word windows.

A window of WINDOW words is an edge from its first to its last WINDOW - 1 words; an edge is repeated
if its words start in two documents or more. Every word covered by a window that also starts in a
document with a smaller id is removed. Windows are judged on the input.

1. Every window has a minimiser: of the GRAM-word grams in it, the one with the least hash. Consecutive
   windows with one minimiser form a segment, a nonbranching piece of the graph that is one row from
   here on. Equal windows have equal minimisers, so only segments whose minimiser starts in two
   documents can hold a repeated window; the others are left out. A document whose words equal those
   of a smaller id's loses all of them (if they fill a window) and takes no further part.
2. Segments with equal words are one edge of the compacted graph, with source coordinates: its first
   document and place. Neighbours give each edge's successors and predecessors over all occurrences, an
   end counting as one. Where one edge is always followed by another, and this one always comes after
   it, both are compacted; a nonbranching path is one row, with its source coordinates and length.
3. Wherever a path's first edge occurs, the whole path does. So only occurrences of first edges are joined
   with the paths, and each of them in a later document gives one span.
4. A window can be shared by segments that differ as a whole, at the end of a repeated passage. Edges
   that share their minimiser with another edge are therefore held against each other window by window,
   once for each edge and not for each occurrence; hits in step with one source give spans too.
5. A span is verified: the words at its source coordinates must be the document's words. Verified spans
   are cut from the text. A minimiser, an edge or a span with many occurrences is dealt over several
   tasks.

Windows are found by two 64-bit hashes together, and no word goes without the comparison of words.
Null and blank texts have no words. A null id is neither a source nor cut. Rows with equal ids must
be equal rows; each gets its row in the result. Other columns are not read. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.bpe import utf8
from pagelode.llm.common import Scratch, bit_map, in_map, lookup
from pagelode.llm.hashing import WORDS, mix, windows

WINDOW = 13
GRAM = 4
#: Words that are hashed and compared at a time.
TOGETHER = 1 << 17


def minimizers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes of words, and for each window the place of its least one, the first among equals."""
    grams = windows(hashes, gram, 1)
    if len(hashes) < window:
        return grams, np.zeros(0, np.int64)
    least, at, have, need = grams, np.arange(len(grams)), 1, window - gram + 1
    while have < need:
        step = min(have, need - have)
        less = least[step:] < least[:-step]
        least, at = np.where(less, least[step:], least[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    return grams, at


def groups(texts: Iterable[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of each text, in groups of texts with TOGETHER words or somewhat more."""
    held, size = [], 0
    for text in texts:
        held.append(text.split())
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def joined(docs: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of documents one after the other, where each document begins, and the document and place of every window inside one."""
    sizes = np.array([len(words) for words in docs])
    first = np.cumsum(sizes) - sizes
    own = np.fromiter(map(WORDS.__getitem__, chain.from_iterable(docs)), np.uint64, sizes.sum())
    count = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(docs)), count)
    place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    return own, first, doc, place


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, n_words, words_sha256 and the segments of every document: three arrays, of minimisers, places of the first window, and hashes of all words with the count of windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, counts, rows = [], [], [], ([], [], [], [])
            for docs in groups(utf8(batch.column(1))):
                own, first, doc, place = joined(docs, window)
                found, at = minimizers(own, window, gram)
                at, whole = at[place], windows(own, window, 2)
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                size = np.diff(np.append(starts, len(at)))
                begin, of = place[starts], doc[starts]
                seg = mix(whole[begin] * np.uint64(0x9E3779B97F4A7C15) + whole[begin + size - 1] + size.astype(np.uint64))
                n += map(len, docs)
                sha += [hashlib.sha256(b" ".join(words)).hexdigest() for words in docs]
                counts.append(np.bincount(of, minlength=len(docs)))
                for held, values in zip(rows, ((begin - first[of]).astype(np.int32), size.astype(np.int16), found[at[starts]].view(np.int64), seg.view(np.int64))):
                    held.append(values)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts)) if counts else []]).astype(np.int32))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in rows]
            types = [pa.int32(), pa.int16(), pa.int64(), pa.int64()]
            entries = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(flat, types)], names=["start", "n", "gram", "seg"])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(offsets, entries)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "words_sha256", "segments"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, words_sha256 string, segments array<struct<start:int,n:smallint,gram:bigint,seg:bigint>>")


def runs(hits: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, words, source, at): one row for each run of windows (doc_id, start, source, at) that follow each other in step."""
    order = Window.partitionBy("doc_id").orderBy("start")
    moves = F.struct("source", (F.col("start") - F.col("at")).alias("step"))
    new = (F.col("start") != F.lag("start").over(order) + 1) | (moves != F.lag(moves).over(order))
    run = F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order)
    found = hits.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.count("*").alias("n"), F.first("source").alias("source"), F.min("at").alias("at"))
    return found.select("doc_id", "start", (F.col("n") + window - 1).cast("int").alias("words"), "source", "at")


def compacted(occurrences: DataFrame) -> DataFrame:
    """(source, at, n): the paths, a row each, with the source coordinates of the first edge and the count of windows.

    occurrences: (doc_id, start, n, source, at) of every repeated edge, its source's own included. Edge f
    continues the path of e if f follows every occurrence of e, and e comes before every occurrence of f.
    Wherever a path's first edge occurs, the whole path does, its source included; so a path's edges lie in
    step in one document, and their order there is the path.
    """
    order = Window.partitionBy("doc_id").orderBy("start")
    edge = F.struct("source", "at")
    after = F.when(F.lead("start").over(order) == F.col("start") + F.col("n"), F.lead(edge).over(order))
    before = F.when(F.lag(F.col("start") + F.col("n")).over(order) == F.col("start"), F.lag(edge).over(order))
    sole = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    edges = occurrences.select("source", "at", "n", after.alias("after"), before.alias("before"))
    edges = edges.groupBy("source", "at").agg(F.first("n").alias("n"), sole("after").alias("after"), sole("before").alias("before"))
    along = Window.partitionBy("source").orderBy("at")
    # the edge before in the source is the one that this edge is always after, and that is always before this one
    joined_on = (F.col("before") == F.lag(edge).over(along)) & (F.lag("after").over(along) == edge)
    path = F.sum(F.when(F.coalesce(joined_on, F.lit(False)), 0).otherwise(1)).over(along)
    return edges.withColumn("path", path).groupBy("source", "path").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n")).drop("path")


def window_rows(texts: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, start): a row for every window of the edges (doc_id, start, n), keyed by its words."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, places, row = [], [], [], 0
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            bounds, edges_ = np.append(0, np.cumsum(lengths)), batch.column(2).flatten()
            starts, sizes = (edges_.field(k).to_numpy() for k in ("start", "n"))
            for docs in groups(utf8(batch.column(1))):
                own, first, doc, place = joined(docs, window)
                some = slice(bounds[row], bounds[row + len(docs)])
                size, of = sizes[some], np.repeat(np.arange(len(docs)), lengths[row : row + len(docs)])
                begin = starts[some] + first[of]
                wanted = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                # an edge may come again in its first document
                hashes, salt = windows(own, window, 2), mix(np.arange(len(docs), dtype=np.uint64))
                value_set = pa.array(hashes[wanted] ^ salt[np.repeat(of, size)])
                hit = np.flatnonzero(pc.is_in(pa.array(hashes[place] ^ salt[doc]), value_set=value_set).to_numpy(zero_copy_only=False))
                keys.append(hashes[place[hit]])
                owners.append(doc[hit] + row)
                places.append(place[hit] - first[doc[hit]])
                row += len(docs)
            key, at, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owners, places))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(at)), pa.array(place, pa.int32())], names=["key", "doc_id", "start"])

    of_doc = edges.groupBy("doc_id").agg(F.collect_list(F.struct("start", F.col("n").cast("int").alias("n"))).alias("own"))
    return texts.join(of_doc, "doc_id").select("doc_id", "text", "own").mapInArrow(run, f"key long, doc_id {kind}, start int")


def slices(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, at, words, slice): the words at the source coordinates (source, at, words), joined by a space."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, own in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                found = text.split()
                rows += [(name, x["at"], x["words"], b" ".join(found[x["at"] : x["at"] + x["words"]])) for x in own]
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [batch.column(0).type, pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["source", "at", "words", "slice"])

    of_doc = wanted.groupBy(F.col("source").alias("doc_id")).agg(F.collect_list(F.struct("at", "words")).alias("own"))
    return texts.join(of_doc, "doc_id").select("doc_id", "text", "own").mapInArrow(run, f"source {kind}, at int, words int, slice binary")


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept text from doc_id, text and spans (start, words, slice).

    A span is cut if the document's words there are those of the slice.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, own in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                found = text.split()
                keep = np.ones(len(found), bool)
                for x in own:
                    a, b = x["start"], x["start"] + x["words"]
                    if b" ".join(found[a:b]) == x["slice"]:
                        keep[a:b] = False
                left = [w for w, k in zip(found, keep.tolist()) if k]
                n.append(len(found))
                gone.append(len(found) - len(left))
                kept.append(b" ".join(left))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def repeated_segments(held: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n, gram, seg): the segments whose minimiser starts in two documents or more."""
    rows = held.where("doc_id is not null").select("doc_id", F.inline("segments"))
    shared = rows.groupBy("gram").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("count")).where("x < y").select("gram", "count")
    shared = scratch.save(shared, "minimisers")
    flags = scratch.save(bit_map(shared, "gram"), "map")
    maybe = rows.where(in_map(flags, F.col("gram")))
    return lookup(maybe, shared.select("gram"), ["gram"], shared)


def found_spans(hits: DataFrame, texts: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, start, words, source, at): spans of documents that repeat what smaller documents have at their sources."""
    edges = hits.groupBy("gram", "seg").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("doc_id").alias("last"), F.first("n").alias("n"), F.count("*").alias("count"))
    edges = scratch.save(edges.select("gram", "seg", "n", "count", F.col("f.doc_id").alias("source"), F.col("f.start").alias("at"), F.col("last").alias("last")), "edges")
    repeated = edges.where("source < last")
    sources = repeated.select("gram", "seg", "source", "at")
    occurrences = scratch.save(lookup(hits, sources, ["gram", "seg"], repeated).select("doc_id", "start", "n", "source", "at"), "occurrences")
    paths = scratch.save(compacted(occurrences), "paths")
    # occurrences of first edges alone meet the paths; the others are inside
    heads = lookup(occurrences.drop("n"), paths, ["source", "at"], repeated).where("doc_id > source")
    spans = scratch.save(heads.select("doc_id", "start", (F.col("n") + window - 1).cast("int").alias("words"), "source", "at"), "path-spans")
    several = edges.groupBy("gram").agg(F.count("*").alias("count"), F.min("source").alias("x"), F.max("source").alias("y")).where("x < y").select("gram", "count")
    several = scratch.save(several, "several")
    mixed = lookup(edges.drop("count"), several, ["gram"], several).select(F.col("source").alias("doc_id"), F.col("at").alias("start"), "n")
    keyed = scratch.save(window_rows(texts, mixed, window), "windows")
    firsts = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("doc_id").alias("last"), F.count("*").alias("count")).where("f.doc_id < last")
    firsts = scratch.save(firsts.select("key", F.col("f.doc_id").alias("source"), F.col("f.start").alias("at"), "count"), "first-windows")
    met = lookup(keyed, firsts, ["key"], firsts).where("doc_id > source").select("doc_id", "start", "source", "at")
    scratch.drop("occurrences", "paths", "edges")
    return spans.unionByName(scratch.save(runs(met, window), "window-spans"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(digests, texts): doc_id, n_words, n_removed, kept_sha256 of every document; doc_id and kept_text of those cut in part."""
    if not 1 <= gram < window:
        raise ValueError("gram must be below window")
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = scratch.save(segments(rows, window, gram), "segments")
    near = scratch.save(repeated_segments(held, scratch), "near")
    whole = held.select("doc_id", "n_words", "words_sha256")
    firsts = whole.where("doc_id is not null").groupBy("words_sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("count")).where("count > 1")
    firsts = scratch.save(firsts, "firsts")
    whole = lookup(whole, firsts.drop("count"), ["words_sha256"], firsts, "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    whole = scratch.save(whole.drop("first"), "whole")
    scratch.drop("segments", "minimisers", "map")
    hits = scratch.save(near.join(whole.where("copy").select("doc_id").distinct(), "doc_id", "left_anti"), "hits")
    scratch.drop("near")
    # rows with equal ids are equal: one of them is looked at
    texts = scratch.save(rows.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    hits = hits.distinct()
    spans = scratch.save(found_spans(scratch.save(hits, "distinct-hits"), texts, window, scratch), "spans")
    wanted = scratch.save(spans.groupBy("source", "at", "words").count(), "wanted")
    words = scratch.save(slices(texts, wanted), "slices")
    verified = lookup(spans, words, ["source", "at", "words"], wanted).groupBy("doc_id").agg(F.collect_list(F.struct("start", "words", "slice")).alias("spans"))
    done = scratch.save(cut(texts.join(verified, "doc_id")), "cut")
    scratch.drop("texts", "spans", "wanted", "slices", "hits", "distinct-hits", "windows")
    again = whole.select("doc_id").join(done, "doc_id")
    empty = hashlib.sha256(b"").hexdigest()
    gone = F.col("copy") & (F.col("n_words") >= window)
    rest = whole.join(done.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(gone, F.lit(empty)).otherwise(F.col("words_sha256")).alias("kept_sha256")
    )
    return again.drop("kept_text").unionByName(rest), done.select("doc_id", "kept_text")
