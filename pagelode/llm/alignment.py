"""Alignment of two tokenizers' ids by a dictionary of groups.

Both tokenizers cut one byte string, a space and the text. Where tokens of both end, the string is cut
into groups; inside a group every A token is linked with every B token whose bytes overlap its own.

1. A text is cut into units, each a run of white space and what follows it up to the next space. Neither
   tokenizer has a token that goes from a letter to a space, so a unit's tokens are those of the whole
   text; a worker encodes a unit once and remembers its groups. Inside a unit, a word and the marks behind
   it are parts with the same property, and it is parts that are encoded. The vocabulary of B is checked
   for both when it is loaded.
2. Distinct groups are interned, and their links are expanded once for each distinct group. A block of
   documents is one row: the distinct groups of each document with their frequencies, as numbers in the
   block's own dictionary, the dictionary, and in how many of its documents each id pair is linked. A
   pair that several groups of a document have counts once for it.
3. Pairs are summed over the blocks, which gives the documents that hold a pair and the highest count of
   each A id. The dictionaries' distinct groups are expanded to their pairs and meet those counts once.
4. Each block's dictionary is joined with the results by group key, a row a group and not a token, and
   meets its block again; a document's sums are frequencies times its groups' results.

Null and empty texts, and texts whose joined A or B bytes aren't the space and the text (U+2581 in a
text), have no tokens and zeros. Null and repeated ids give a row each. Other columns aren't read,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.bpe import byte_letters, utf8
from pagelode.llm.common import Scratch, lookup
from pagelode.llm.hashing import HELD

#: A block ends at so many units, or with one document that has more.
BLOCK_UNITS = 1 << 17
#: Units and their parts that a worker remembers before it starts afresh, between two blocks.
REMEMBER = 800_000
#: Bytes of texts whose new units are encoded together.
TOGETHER = 1 << 20
#: A unit ends before a space that follows something other than white space; most texts have no other space.
CUT = re.compile(r"(?<=[^\s▁]) ")
NOT_CUT = re.compile(r"[\s▁] ")
#: Inside a unit a part ends between a letter and one of these marks, and between a mark and a line's end.
PART = re.compile(r'(?<=[A-Za-zÀ-ÖØ-öø-ɏА-я])(?=[.,;:!?"()\n-])|(?<=[.,;:!?])(?=\n)')
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Tokens:
    """The ids and the lengths in bytes of both tokenizers' tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes = {i: bytes(byte.get(c, 0) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B goes from a letter to a space: texts can't be cut into units")
        #: whether no piece of B goes across the end of a part
        self.parts = not any(PART.search(p) for p in pieces)
        self.b_bytes = [bytes.fromhex(m[1]) if (m := BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, parts: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """A's and B's ids of each part and whether both give its bytes."""
        a = self.a.encode_batch(parts, add_special_tokens=False)
        # B adds a space: the one that a part begins with, but not to nothing; other parts stand behind a line's end, which joins nothing
        spaced = [p[1:] if p[:1] == " " and len(p) > 1 else ("a " if p == " " else "\n" + p) for p in parts]
        skip = {" ": len(self.b.encode("a"))}
        line = len(self.b.encode("\n"))
        for part, x, y in zip(parts, a, self.b.encode(spaced, num_threads=1)):
            own, other, raw = x.ids, y[skip.get(part, 0 if part[:1] == " " else line) :], part.encode()
            # A's tokens are bytes of the text in order: if none is missing, all are there
            yield own, other, sum([len(self.a_bytes[i]) for i in own]) == len(raw) and b"".join(map(self.b_bytes.__getitem__, other)) == raw

    def steps(self, a: Sequence[int], b: Sequence[int]) -> Iterator[tuple[int, int, bool]]:
        """The places of the tokens whose bytes overlap, in order, and whether both end there; both have as many bytes."""
        size_a, size_b = self.a_bytes, self.b_bytes
        i = j = 0
        x, y = len(size_a[a[0]]), len(size_b[b[0]])
        while True:
            yield i, j, x == y
            here = x <= y
            if y <= x:
                j += 1
                if j == len(b):
                    return
                y += len(size_b[b[j]])
            if here:
                i += 1
                x += len(size_a[a[i]])

    def groups(self, a: list[int], b: list[int]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """The groups of ids between the places where tokens of both end."""
        if len(a) == 1 or len(b) == 1:
            return [(tuple(a), tuple(b))]
        out, p, q = [], 0, 0
        for i, j, end in self.steps(a, b):
            if end:
                out.append((tuple(a[p : i + 1]), tuple(b[q : j + 1])))
                p, q = i + 1, j + 1
        return out

    def links(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        """The pairs of ids of a group's tokens whose bytes overlap, one for each pair of tokens."""
        if len(a) == 1 or len(b) == 1:
            return [(x, y) for x in a for y in b]
        return [(a[i], b[j]) for i, j, _ in self.steps(a, b)]


def cut(text: str) -> list[str]:
    """The units of a text, each without the space that it begins with; the first begins with the one before the text."""
    if NOT_CUT.search(" " + text):
        first, *rest = CUT.split(" " + text)
        return [first[1:], *rest]
    return text.split(" ")


@lru_cache(maxsize=1)
def loaded(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


@lru_cache(maxsize=1)
def dictionary(a_path: str, b_path: str) -> Dictionary:
    """The worker's own: what it remembers changes no result."""
    return Dictionary(loaded(a_path, b_path))


HELD["alignment"] = dictionary.cache_clear


def key_of(a: tuple[int, ...], b: tuple[int, ...]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def ids_of(key: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(tuple(map(int, side.split(","))) for side in key.split("|"))


class Dictionary(dict):
    """Units by text, as numbers; what a number stands for is in lists. Groups and pairs are interned."""

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens = tokens
        self.start()

    def start(self) -> None:
        self.clear()
        self.inexact: set[int] = set()
        self.parts: dict[str, tuple] = {}  # by text, what units has
        self.units: list[tuple[list[int], int, int, str, bool]] = []  # groups, A tokens, B tokens, digest text, whether exact
        self.group_no: dict[tuple, int] = {}
        self.groups: list[tuple[str, int, list[int]]] = []  # key, links, distinct pairs
        self.pair_no: dict[tuple[int, int], int] = {}
        self.pairs: list[tuple[int, int]] = []

    def learn(self, units: Iterable[str]) -> None:
        """Takes in the units that aren't known yet, from their parts; new parts are encoded together."""
        split = PART.split if self.tokens.parts else lambda unit: [unit]
        new = {u: split(" " + u) for u in dict.fromkeys(units) if u not in self}
        parts = [p for p in dict.fromkeys(chain.from_iterable(new.values())) if p not in self.parts]
        for part, (a, b, exact) in zip(parts, self.tokens.encode(parts) if parts else ()):
            own = [self.group(g) for g in self.tokens.groups(a, b)] if exact else []
            self.parts[part] = own, len(a), len(b), ";".join([self.groups[g][0] for g in own]), exact
        for unit, pieces in new.items():
            self[unit] = len(self.units)
            found = list(map(self.parts.__getitem__, pieces))
            if len(found) == 1:
                self.units.append(found[0])
            else:
                own, a, b, text, exact = zip(*found)
                self.units.append((list(chain.from_iterable(own)), sum(a), sum(b), ";".join(text), all(exact)))
            if not self.units[-1][4]:
                self.inexact.add(self[unit])

    def group(self, g: tuple) -> int:
        got = self.group_no.get(g)
        if got is None:
            links = self.tokens.links(*g)
            for p in links:
                if p not in self.pair_no:
                    self.pair_no[p] = len(self.pairs)
                    self.pairs.append(p)
            got = self.group_no[g] = len(self.groups)
            self.groups.append((key_of(*g), len(links), sorted({self.pair_no[p] for p in links})))
        return got


def _spread(owner: np.ndarray, item: np.ndarray, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, member) for each member of each item's list; items are numbers of lists."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum())
    first, n = np.cumsum(sizes) - sizes, sizes[item]
    at = np.repeat(first[item] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(owner, n), flat[at]


def _distinct(owner: np.ndarray, item: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of owner and item, and how often each comes."""
    key, n = np.unique(owner * many + item, return_counts=True)
    return key // max(many, 1), key % max(many, 1), n


BLOCK = "block long, documents array<struct<doc_id:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,size:int>>, entry array<int>, times array<int>, dictionary array<string>, pairs array<struct<a:int,b:int,n:long>>"


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of documents (doc_id, text): see BLOCK. entry and times have size values a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    most, together, remember = BLOCK_UNITS, TOGETHER, REMEMBER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dictionary(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            names, texts = batch.column(0), utf8(batch.column(1))
            units: list[list[int]] = []
            first = held = ahead = 0
            parts: list[list[str]] = []
            for at, raw in enumerate(texts):
                if at == ahead:  # the next texts' units, so that new ones are encoded together
                    if len(own) + len(own.parts) >= remember:
                        if units:
                            yield block(number, names[first:at], units, own)
                            number, first, held, units = number + 1, at, 0, []
                        own.start()
                    size, parts = 0, []
                    while ahead < len(texts) and size < together:
                        size += len(texts[ahead])
                        parts.append(cut(texts[ahead].decode()) if texts[ahead] else [])
                        ahead += 1
                    own.learn(chain.from_iterable(parts))
                    parts.reverse()
                found = list(map(own.__getitem__, parts.pop()))
                units.append(found if own.inexact.isdisjoint(found) else [])
                held += len(units[-1])
                if held >= most or at == len(texts) - 1:
                    yield block(number, names[first : at + 1], units, own)
                    number, first, held, units = number + 1, at + 1, 0, []

    def block(number: int, names: pa.Array, units: list[list[int]], own: Dictionary) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        used, unit = np.unique(np.fromiter(chain.from_iterable(units), np.int64, sizes.sum()), return_inverse=True)
        doc = np.repeat(np.arange(len(units)), sizes)
        some = [own.units[u] for u in used.tolist()]
        counted = lambda k: np.bincount(doc, np.array([x[k] for x in some], float)[unit] if some else None, len(units)).astype(np.int64)
        owner, group = _spread(doc, unit, [x[0] for x in some])
        groups, entry = np.unique(group, return_inverse=True)
        held = [own.groups[g] for g in groups.tolist()]
        of, item, times = _distinct(owner, entry, len(held))
        links = np.bincount(of, times * np.array([x[1] for x in held], np.int64)[item] if held else None, len(units)).astype(np.int64)
        of_pair, pair = _spread(of, item, [x[2] for x in held])
        met = np.bincount(_distinct(of_pair, pair, len(own.pairs))[1], minlength=1)
        linked = np.flatnonzero(met)
        sha = [hashlib.sha256(";".join([own.units[u][3] for u in x]).encode()).hexdigest() if x else "" for x in units]
        per_doc = [names, counted(1), counted(2), np.bincount(owner, minlength=len(units)), links, sha, np.bincount(of, minlength=len(units))]
        kinds = [names.type, *[pa.int64()] * 4, pa.string(), pa.int32()]
        labels = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "size"]
        pairs = [own.pairs[p] for p in linked.tolist()]
        cells = [
            pa.array([number], pa.int64()),
            _one(pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(per_doc, kinds)], names=labels)),
            _one(pa.array(item, pa.int32())),
            _one(pa.array(times, pa.int32())),
            _one(pa.array([x[0] for x in held], pa.string())),
            _one(pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), pa.array(met[linked], pa.int64())], names=["a", "b", "n"])),
        ]
        return pa.RecordBatch.from_arrays(cells, names=["block", "documents", "entry", "times", "dictionary", "pairs"])

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK.format(kind=kind))


def _one(values: pa.Array) -> pa.ListArray:
    """A list column with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def expanded(keys: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, a, b, m): the id pairs of each group key (key), m links each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(a_path, b_path)
        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column(0).to_pylist():
                times: dict[tuple[int, int], int] = {}
                for p in tokens.links(*ids_of(key)):
                    times[p] = times.get(p, 0) + 1
                rows += [(key, *p, m) for p, m in times.items()]
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "a", "b", "m"])

    return keys.select("key").mapInArrow(run, "key string, a int, b int, m long")


def _summed(kind: str):
    """For a block and its dictionary's results, the sums of its documents."""

    def run(held: pa.Table, results: pa.Table) -> pa.Table:
        rows = held.combine_chunks()
        docs = rows["documents"].combine_chunks().flatten()
        entry, times = (rows[k].combine_chunks().flatten().to_numpy().astype(np.int64) for k in ("entry", "times"))
        place = results["place"].to_numpy()
        doc = np.repeat(np.arange(len(docs)), docs.field("size").to_numpy())
        out = {k: docs.field(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        for k in ("best", "sum"):
            of_group = np.zeros(max(len(place), 1), np.int64)
            of_group[place] = results[k].to_numpy()
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, doc, of_group[entry] * times)
            out["n_best" if k == "best" else "count_sum"] = pa.array(total)
        return pa.table(out | {"groups_sha256": docs.field("groups_sha256")})

    return run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _tables(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> tuple[Scratch, DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "alignment")
    held = scratch.save(blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), a_path, b_path), "blocks")
    pairs = scratch.save(held.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    return scratch, held, pairs


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n): all linked id pairs with the count of documents that hold them linked."""
    return _tables(docs, a_path, b_path, id_col, text_col)[2]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    scratch, held, pairs = _tables(docs, a_path, b_path, id_col, text_col)
    top = pairs.groupBy("a").agg(F.max("n").alias("most"))
    rated = pairs.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    words = scratch.save(held.select("block", F.posexplode("dictionary").alias("place", "key")), "words")
    keys = scratch.save(words.groupBy("key").count(), "keys")
    links_ = scratch.save(expanded(keys, a_path, b_path), "links")
    results = lookup(links_, rated, ["a", "b"]).groupBy("key").agg(F.sum(F.col("m") * F.col("best")).alias("best"), F.sum(F.col("m") * F.col("n")).alias("sum"))
    results = scratch.save(results, "results")
    own = scratch.save(lookup(words, results, ["key"], keys).select("block", "place", "best", "sum"), "own")
    scratch.drop("words", "links", "keys", "pairs")
    run, schema = _summed(docs.schema[id_col].dataType.simpleString())
    # blocks of one partition follow each other; a task holds one block and its dictionary
    return held.select("block", "documents", "entry", "times").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, schema)
