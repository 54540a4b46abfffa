"""Token ids as grammar-compressed shards (Re-Pair) with random access.

Documents are dealt by id range and sorted; each task cuts its run of documents into shards of
about SHARD_TOKENS ids, a document never being split. In a shard the frequent pairs of adjacent
symbols are replaced by new symbols, round by round, until no pair is frequent: counts of all pairs
are taken (by a hash first, exactly for those that may be frequent), and where frequent pairs overlap
the more frequent one wins, of equal ones the one with the greater hash, and in a run of one symbol
every other one. A third of a long repeat goes in a round, so rounds grow with its logarithm.
A shard is one row of a Parquet table:

    part, shard         its place; parts and shards in order hold ascending ids
    part_start          ids before it in its part
    n_tokens            ids in it
    doc_ids, doc_tokens its documents in order
    base                the first new symbol
    rules               two little-endian unsigned 32-bit symbols for each new symbol, in order
    rule_lengths        how many ids each new symbol stands for, likewise
    symbols             the shard's symbols, likewise

Any range of ids is decoded from the symbols that cover it: a running sum of lengths finds them.

Null text is empty; a document has its end id at least. Null ids come first; equal ids are ordered
by text. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.bpe import REMEMBER, Splitter, byte_letters, utf8
from pagelode.llm.common import Scratch
from pagelode.llm.hashing import HELD

END_ID = 1
SHARD_TOKENS = 1 << 18
#: A pair gets a rule if it occurs so often in a shard; rounds end when no pair does.
FREQUENT = 24


class LibraryEncoder(dict):
    """The tokenizers library's ids, word by word: its model encodes each word once and it is remembered.

    Keys are texts without ASCII white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as f:
            self.split = Splitter(path, {t["content"]: t["id"] for t in json.load(f)["added_tokens"]})
        self.letters = dict(enumerate(byte_letters()))
        self.of_word: dict[str | int, bytes] = {}

    def word(self, word: str | int) -> bytes:
        if len(self.of_word) >= REMEMBER:
            self.of_word.clear()
        if isinstance(word, int):
            ids = [word]
        else:
            # printable ASCII stands for itself
            mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(mapped)]
        got = self.of_word[word] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= REMEMBER:
            self.clear()
        known = self.of_word.get
        got = self[chunk] = b"".join([known(w) or self.word(w) for w in self.split(chunk)])
        return got

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


HELD["grammar"] = library.cache_clear


def chosen(rank: np.ndarray) -> np.ndarray:
    """The places of ranks above both neighbours', and every other place of a run of equal ones that its neighbours leave; 0 is never chosen."""
    wide = np.zeros(len(rank) + 2, rank.dtype)
    wide[1:-1] = rank
    before, after = wide[:-2], wide[2:]
    tied = np.flatnonzero(rank[1:] == rank[:-1])
    tied = tied[rank[tied] > 0]
    alone = np.flatnonzero((rank > before) & (rank > after))
    if not len(tied):
        return alone
    # runs of ties; one that ends below its neighbour gives up the place beside it
    begins = np.flatnonzero(np.diff(tied, prepend=-2) > 1)
    start, end = tied[begins], tied[np.append(begins[1:], len(tied)) - 1] + 1
    first, last = start + (rank[start] < before[start]), end - (rank[end] < after[end])
    count = (last - first) // 2 + 1
    return np.sort(np.append(alone, np.repeat(first - 2 * (np.cumsum(count) - count), count) + 2 * np.arange(count.sum())))


def compress(ids: np.ndarray, frequent: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """base, rules (n x 2), rule lengths and symbols that decompress() turns into the ids again."""
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols = ids.astype("<u4")
    rules, lengths = np.zeros((0, 2), "<u4"), np.zeros(0, np.int64)
    slots = ((symbols[:-1] * np.uint32(0x9E3779B1) ^ symbols[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(14)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slots, minlength=1 << 18)[slots] >= frequent)
    while len(maybe):
        coded = pa.array(symbols[maybe].astype(np.uint64) << np.uint64(32) | symbols[maybe + 1]).dictionary_encode()
        of, kinds = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        counts = np.bincount(of)
        often = np.flatnonzero(counts >= frequent)
        if not len(often):
            break
        # the rank of a frequent pair among all of the round: by count, then by hash
        often = often[np.lexsort((kinds[often] * np.uint64(0x9E3779B97F4A7C15), counts[often]))]
        ranks = np.zeros(len(kinds), np.int32)
        ranks[often] = np.arange(1, len(often) + 1)
        rank = np.zeros(len(symbols), np.int32)
        rank[maybe] = ranks[of]
        at = chosen(rank)
        # the most frequent pair is chosen at half its places or more; the others wait if they get less
        kept = np.bincount(rank[at], minlength=len(often) + 1) * 2 >= frequent
        at = at[kept[rank[at]]]
        first = base + len(rules)
        symbols[at] = (first + np.cumsum(kept) - 1)[rank[at]]
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols = symbols[left]
        pair = kinds[often[np.flatnonzero(kept) - 1]]
        both = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype("<u4")
        each = np.ones(both.shape, np.int64)
        old = both >= base
        each[old] = lengths[both[old].astype(np.int64) - base]
        rules, lengths = np.concatenate([rules, both]), np.append(lengths, each.sum(1))
        # only pairs with a new symbol and those that were frequent can be frequent now
        new, was = symbols >= first, rank[left] > 0
        maybe = np.flatnonzero(was[:-1] | new[:-1] | new[1:])
    return base, rules, lengths.astype("<u4"), symbols


def decompress(base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: every rule is expanded once, and each symbol copies its ids from there."""
    expanded = rules.reshape(-1)
    while (new := expanded >= base).any():
        # symbols are replaced by their two parts until none is new
        ends = np.cumsum(np.where(new, 2, 1))
        grown = np.empty(ends[-1], expanded.dtype)
        grown[ends[~new] - 1] = expanded[~new]
        both = rules[expanded[new].astype(np.int64) - base]
        grown[ends[new] - 2], grown[ends[new] - 1] = both[:, 0], both[:, 1]
        expanded = grown
    new = np.flatnonzero(symbols >= base)
    of = symbols[new].astype(np.int64) - base
    size = np.ones(len(symbols), np.int64)
    size[new] = lengths[of]
    begin = np.cumsum(size) - size
    out = np.repeat(symbols, size)
    begin, size, source = begin[new], size[new], (np.cumsum(lengths, dtype=np.int64) - lengths)[of]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + within] = expanded[np.repeat(source, size) + within]
    return out


def reached(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The numbers of the rules that symbols use, themselves or through other rules, ascending."""
    found = new = np.unique(symbols[symbols >= base]).astype(np.int64) - base
    while len(new):
        parts = rules[new].reshape(-1)
        new = np.setdiff1d(parts[parts >= base].astype(np.int64) - base, found)
        found = np.union1d(found, new)
    return found


def decode_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of one shard's row. Only the symbols that cover them are expanded, and of the rules only those that these symbols use."""
    rules, lengths = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4")
    symbols, base = np.frombuffer(row["symbols"], "<u4"), row["base"]
    each = np.ones(len(symbols), np.int64)
    new = symbols >= base
    each[new] = lengths[symbols[new].astype(np.int64) - base]
    ends = np.cumsum(each)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skipped = int(ends[first - 1]) if first else 0
    some = symbols[first : last + 1]
    used = reached(base, rules, some)

    def renumbered(x: np.ndarray) -> np.ndarray:
        return np.where(x >= base, base + np.searchsorted(used, x.astype(np.int64) - base), x).astype("<u4")

    return decompress(base, renumbered(rules[used]), lengths[used], renumbered(some))[start - skipped : stop - skipped]


SHARDS = "part int, shard int, part_start long, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, base long, rules binary, rule_lengths binary, symbols binary"


def write_shards(docs: DataFrame, path: str, vocabulary: str, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, add the end id, and write the shards to path in ascending id order."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = library(vocabulary), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        shard = start = held = 0
        names: list = []
        parts: list[bytes] = []
        id_type = None

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            base, rules, lengths, symbols = compress(ids)
            values = [part, shard, start, len(ids), names, [len(p) // 4 for p in parts], base, rules.tobytes(), lengths.tobytes(), symbols.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]
            cols = ["part", "shard", "part_start", "n_tokens", "doc_ids", "doc_tokens", "base", "rules", "rule_lengths", "symbols"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=cols)

        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                names.append(name)
                parts.append(encoder.encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= shard_tokens:
                    yield row()
                    shard, start, held, names, parts = shard + 1, start + held, 0, [], []
        if parts:
            yield row()

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(run, SHARDS.format(kind=kind)).write.option("compression", "zstd").parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its decoded ids.

    Sums of ids run over the parts, a row for each task that wrote; in a part the shards carry theirs.
    """
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                ids = decompress(x["base"], np.frombuffer(x["rules"], "<u4").reshape(-1, 2), np.frombuffer(x["rule_lengths"], "<u4"), np.frombuffer(x["symbols"], "<u4")).astype("<u4").tobytes()
                n = np.array(x["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                start = ends - n + x["part_start"] + x["before"]
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(starts, "part").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and read every document back from the files."""
    path = f"{Scratch(docs.sparkSession, 'tokens').root}/shards"
    write_shards(docs, path, vocabulary, id_col=id_col, text_col=text_col)
    return read_shards(docs.sparkSession.read.parquet(path))
