"""BPE encoding and decoding of word_bpe_49k.json and vocabularies like it, without the library.

A text is cut at the special tokens' strings, put into NFC and lower case, and split into words by
the vocabulary's pattern. Each word is encoded by a contiguous rank array: one list holds the parts'
boundaries, one the ranks of the pairs of adjacent parts; the least rank is scanned for, its
boundary deleted, and the two neighbouring ranks are looked up anew. Words are short, so the scans
are too. A Python worker remembers words it has met, up to a bound; this changes no result.

Null text is empty and has no ids; any text of any length is encoded whole. Input columns other
than id and text are not read; repeated ids give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagelode.llm.hashing import HELD, only

#: The pattern and the end of a word as the vocabulary's file has them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Entries that a worker remembers before it starts afresh.
REMEMBER = 800_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    out, free = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Splitter:
    """The words of a text without ASCII white space, as the vocabulary's normaliser and pattern give them."""

    def __init__(self, path: str, special: dict[str, int]):
        self.path, self.special, self.library = path, special, None
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")")

    def by_library(self, piece: str) -> list[str]:
        """For letters newer than Python's tables, which differ between libraries: the normaliser and splitter themselves."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        low = self.library.normalizer.normalize_str(piece)
        return [low[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def __call__(self, chunk: bytes) -> list[str | int]:
        """Words, and ids of special tokens."""
        text = chunk.decode()
        # most are letters, or letters and then marks: these are one match of the pattern each
        bare = text.rstrip(".,;:!?")
        low = bare.lower()
        if low.isalpha() and (low.isascii() or ("\u03a3" not in bare and unicodedata.is_normalized("NFC", bare))):
            return [low, text[len(bare) :]] if len(bare) < len(text) else [low]
        out: list[str | int] = []
        for k, piece in enumerate(self.cut.split(text) if "<" in text else [text]):
            if k % 2:
                out.append(self.special[piece])
            else:
                # lower() writes a final sigma; the library maps letters one by one
                low = unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3").lower()
                new = not low.isascii() and any(unicodedata.category(c) == "Cn" for c in low)
                out += self.by_library(piece) if new else self.words.findall(low)
        return out


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.ids: dict[str, int] = data["model"]["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(data["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self.split = Splitter(path, self.special)
        self.of_word: dict[str | int, bytes] = {}
        self.of_chunk = _Chunks(self)

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word by a contiguous rank array."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += END
        n, none = len(parts), len(self.ranks)
        rank = self.ranks.get
        at = list(range(n + 1))  # boundaries, in letters
        joined = "".join
        ranks = [rank((parts[i], parts[i + 1]), none) for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            del at[i + 1], ranks[i]
            here = joined(parts[at[i] : at[i + 1]])
            if i:
                ranks[i - 1] = rank((joined(parts[at[i - 1] : at[i]]), here), none)
            if i < len(ranks):
                ranks[i] = rank((here, joined(parts[at[i + 1] : at[i + 2]])), none)
        return [self.ids[joined(parts[a:b])] for a, b in zip(at, at[1:])]

    def encode_chunk(self, chunk: bytes) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers, of a text without ASCII white space."""
        out = []
        for word in self.split(chunk):
            got = self.of_word.get(word)
            if got is None:
                if len(self.of_word) >= REMEMBER:
                    self.of_word.clear()
                ids = [word] if isinstance(word, int) else self.encode_word(word)
                got = self.of_word[word] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(got)
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text. No word, special token or composition spans ASCII white space."""
        return b"".join(map(self.of_chunk.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        """The tokens, special ones too, joined by a space: what the library does where a file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Chunks(dict):
    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= REMEMBER:
            self.clear()
        got = self[chunk] = self.bpe.encode_chunk(chunk)
        return got


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


HELD["bpe"] = loaded.cache_clear


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's texts as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded text of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe")
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = [bpe.encode(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, without writing ids to a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe")
        bpe, sha = loaded(vocabulary), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in utf8(batch.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
