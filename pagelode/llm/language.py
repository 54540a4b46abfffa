"""Language identification: script ranges narrow the candidates, Viterbi labels the spans.

The model is learned from all labelled rows given: for each language the log shares of three-letter pieces of
words (the pieces of " word "), and which scripts it is written in. A word's script, by ranges of code
points, leaves the languages that use it as candidates; its pieces give a score for each. Viterbi then
finds the languages of a text's words that score best when every switch costs PENALTY. The prediction
is the language with the most letters.

A word is evidence for its label if the language uses its script and its pieces have a higher mean
score than letters drawn evenly from the language's own would have, and than a piece never seen. The
score is the share of a text's letters that are evidence for the prediction. What is kept as text in a
language has evidence for any languages, in a share that is held against that of all labelled rows.

A text without letters, or null, is "und" with score 0, as is every text if nothing was learned. A
word whose script no language uses scores alike for all and is evidence for none. Texts are read whole. Equal scores go to the
first language in order of code point. Rows without text or language aren't learned from. Repeated
rows get equal results. Input columns other than those named are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagelode.llm.bpe import utf8
from pagelode.llm.common import Scratch, free
from pagelode.llm.hashing import only

#: Pieces kept for each language, the most frequent.
PIECES = 20_000
PENALTY = 10.0
#: A language uses a script if so large a share of its learned words is in it.
USES = 0.02
REMEMBER = 300_000
#: The quantile of labelled texts' evidence that tells what is usual, and the parts of a share that it is counted in.
USUAL = 0.002
GRID = 10_000

# First code point of ranges of scripts.
SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = [s for s, _ in SCRIPTS]


def bare(words: Iterable[bytes]) -> list[str]:
    """Each word's letters in lower case; words have no spaces."""
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in b" ".join(words).decode().lower().split(" ")]


def pieces(word: str) -> Iterator[str]:
    padded = f" {word} "
    return (padded[i : i + 3] for i in range(len(padded) - 2))


def coded(words: list[str]) -> np.ndarray:
    """The pieces of words of letters, one word after the other, each as a number of three code points of 21 bits."""
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 32]


def first_letters(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place in SCRIPTS of each word's first letter, from the words' pieces and lengths."""
    return np.searchsorted(_STARTS, codes[np.cumsum(sizes) - sizes] >> 21 & 0x1FFFFF, "right") - 1


@dataclass
class Model:
    langs: list[str]
    weights: dict[str, tuple[float, ...]] = field(default_factory=dict)
    unseen: tuple[float, ...] = ()
    uses: dict[str, set[str]] = field(default_factory=dict)
    #: The mean piece score that a word must exceed to be evidence for each language.
    floors: tuple[float, ...] = ()


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows' languages from every labelled row; words are counted before their pieces."""
    labelled = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text is not null and lang is not null")

    def counts(words: dict[str, Counter], texts: Counter) -> pa.RecordBatch:
        rows = [(lang, "text", "", n) for lang, n in texts.items()]
        for lang, own in words.items():
            found, n = bare(own), np.fromiter(own.values(), np.int64, len(own))
            n, found = n[list(map(bool, found))], [w for w in found if w]
            if found:
                codes, sizes = coded(found), np.array(list(map(len, found)))
                rows += [(lang, "script", SCRIPTS[i][1], m) for i, m in enumerate(np.bincount(first_letters(codes, sizes), n).astype(np.int64).tolist()) if m]
                sums = pa.table({"code": codes, "n": np.repeat(n, sizes)}).group_by("code").aggregate([("n", "sum")])
                rows += [(lang, "piece", "".join(chr(c >> k & 0x1FFFFF) for k in (42, 21, 0)), m) for c, m in zip(sums["code"].to_pylist(), sums["n_sum"].to_pylist())]
        cols = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()])], names=["lang", "kind", "value", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language")
        words, texts = defaultdict(Counter), Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                texts[lang] += 1
                words[lang].update(text.split())
            if sum(map(len, words.values())) > REMEMBER:
                yield counts(words, texts)
                words, texts = defaultdict(Counter), Counter()
        yield counts(words, texts)

    found = labelled.mapInArrow(run, "lang string, kind string, value string, n long").groupBy("lang", "kind", "value").agg(F.sum("n").alias("n"))
    found = Scratch(rows.sparkSession, "language").save(found, "counts")
    model = Model(sorted(r["lang"] for r in found.where("kind = 'text'").collect()))
    if not model.langs:
        return model
    of: dict[str, dict[str, int]] = {}
    for lang in model.langs:
        own = found.where(F.col("lang") == lang)
        of[lang] = {r["value"]: r["n"] for r in own.where("kind = 'piece'").orderBy(F.desc("n"), "value").limit(PIECES).collect()}
        scripts = {r["value"]: r["n"] for r in own.where("kind = 'script'").collect()}
        for name, n in scripts.items():
            if n >= USES * sum(scripts.values()):
                model.uses.setdefault(name, set()).add(lang)
    kinds = len(set().union(*of.values())) + 1
    totals = [sum(of[x].values()) + 0.5 * kinds for x in model.langs]
    model.weights = {p: tuple(float(np.log((of[x].get(p, 0) + 0.5) / t)) for x, t in zip(model.langs, totals)) for p in set().union(*of.values())}
    model.unseen = tuple(float(np.log(0.5 / t)) for t in totals)
    model.floors = tuple(max(u, -3 * float(np.log(max(1, len(set().union(*of[x])))))) for x, u in zip(model.langs, model.unseen))
    return model


def usual(shares: DataFrame, share: str) -> float:
    """A low quantile of the rows' shares, in whole parts of GRID, from the count of each; null shares don't count. 1 without rows."""
    counts = sorted(shares.where(F.col(share).isNotNull()).groupBy(F.floor(F.col(share) * GRID).alias("part")).count().collect())
    rank = int(USUAL * (sum(n for _, n in counts) - 1))
    below = accumulate(n for _, n in counts)
    return next((part / GRID for (part, _), n in zip(counts, below) if n > rank), 1.0)


class Scores(dict):
    """For each word met, its row in a matrix: a score for each language, whether it is evidence for each, and its letters."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        # pieces in the order of their codes; no piece has the last
        codes = np.array([ord(p[0]) << 42 | ord(p[1]) << 21 | ord(p[2]) for p in model.weights] + [-1 + (1 << 63)], np.int64)
        weights = np.array([*model.weights.values(), model.unseen or (0.0,) * len(model.langs)], np.float32).reshape(len(codes), len(model.langs))
        order = np.argsort(codes)
        self.codes, self.weights = codes[order], weights[order]
        self.users = np.array([[x in model.uses.get(s, ()) for x in model.langs] for _, s in SCRIPTS])
        self.floors = np.array(model.floors, np.float32)
        self.matrix = np.zeros((0, 2 * len(model.langs) + 1), np.float32)

    def learn(self, words: list[bytes]) -> None:
        """Score words that are new, all at once."""
        found = bare(words)
        rows = np.zeros((len(words), self.matrix.shape[1]), np.float32)
        lettered = np.array([i for i, w in enumerate(found) if w], np.int64)
        if len(lettered):
            own = [found[i] for i in lettered.tolist()]
            codes, sizes = coded(own), np.array(list(map(len, own)))
            at = np.searchsorted(self.codes, codes)
            flat = np.where(self.codes[at] == codes, at, len(self.codes) - 1)
            sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            users = self.users[first_letters(codes, sizes)]
            k = len(self.model.langs)
            rows[lettered, k:-1] = users & (sums > self.floors * sizes[:, None])
            kept = np.where(users, sums, np.inf).min(1)
            sums = np.where(users, sums, kept[:, None] - PENALTY)
            sums = np.maximum(sums - sums.max(1, keepdims=True), -4 * PENALTY)
            rows[lettered, :k] = np.where(users.any(1)[:, None], sums, 0)
            rows[lettered, -1] = sizes
        start = len(self)
        if start + len(words) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix[:start], np.zeros((start + len(words), rows.shape[1]), np.float32)])
        self.matrix[start : start + len(words)] = rows
        self.update(zip(words, range(start, start + len(words))))

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each text its words' rows; none where nothing was learned."""
        if not self.model.langs:
            yield from (np.zeros((0, 1), np.float32) for _ in texts)
            return
        for at in range(0, len(texts), 200):
            split = [t.split() for t in texts[at : at + 200]]
            met = set().union(*split)
            new = met.difference(self)
            if new and len(self) + len(new) > REMEMBER:
                self.clear()
                new = met
            if new:
                self.learn(list(new))
            for words in split:
                places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
                yield self.matrix[places]


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best labels (n) of words' scores (n x languages) when every switch costs the penalty.

    If for every other language no stretch of words gains more than one penalty over the best single
    language, one label holds for all: a detour of m stretches costs m penalties at least.
    """
    n, k = scores.shape
    best = int(np.argmax(scores.sum(0, dtype=np.float64)))
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
    if n == 0 or (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        return np.full(n, best)
    # few languages: plain lists cost less than array calls for each word
    value, came = scores[0].tolist(), []
    for row in scores[1:].tolist():
        most = max(value)
        top, moved = value.index(most), most - penalty
        came.append([i if v >= moved else top for i, v in enumerate(value)])
        value = [(v if v >= moved else moved) + x for v, x in zip(value, row)]
    at = value.index(max(value))
    out = [at]
    for back in reversed(came):
        at = back[at]
        out.append(at)
    return np.array(out[::-1], np.int64)


def predict(langs: list[str], found: np.ndarray, penalty: float) -> tuple[str, float, float, list[dict]]:
    """The language, the shares of letters that are evidence for it and for any label, and the spans of one text, from its words' rows."""
    letters, k = found[:, -1], len(langs)
    if not langs or not letters.sum():
        return "und", 0.0, 0.0, []
    labels = viterbi(found[:, :k], penalty)
    total = letters.sum(dtype=np.float64)
    top = int(np.bincount(labels, letters, k).argmax())
    shares = np.bincount(labels, letters * found[np.arange(len(labels)), k + labels], k) / total
    starts = np.flatnonzero(np.diff(labels, prepend=-1))
    spans = [{"start": a, "end": b, "lang": langs[labels[a]]} for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(labels)])]
    return langs[top], min(1.0, float(shares[top])), min(1.0, float(shares.sum())), spans


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score and spans (first word, end, lang) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language")
        known = Scores(shipped.value)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            got = [predict(known.model.langs, x, penalty) for x in known.of(utf8(batch.column(1)))]
            cols = [pa.array([g[i] for g in got], t) for i, t in ((0, pa.string()), (1, pa.float64()), (3, span))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def in_a_language(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", penalty: float = PENALTY, lang_col: str = "lang") -> DataFrame:
    """The input's rows of whose text's letters at least that part of the usual share are evidence for languages.

    Usual is what all labelled rows of the input have; the shares are written beside the rows, so that each
    text is judged once. Where nothing was learned, as no row has a label, there is no evidence against a
    text: all with a letter stay. Null texts and texts without letters go. An empty table gives an empty table.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = free(docs, "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language")
        known = Scores(shipped.value)
        for batch in batches:
            texts = utf8(batch.column(batch.schema.get_field_index(text_col)))
            if known.model.langs:
                got = [predict(known.model.langs, x, penalty) for x in known.of(texts)]
                shares = [None if lang == "und" else share for lang, _, share, _ in got]
            else:
                shares = [1.0 if any(c.isalpha() for c in t.decode()) else None for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shares, pa.float64())], names=[*batch.schema.names, name])

    judged = Scratch(docs.sparkSession, "language").save(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())])), "shares")
    labelled = judged.where(F.col(lang_col).isNotNull()) if lang_col in docs.columns else judged.limit(0)
    bound = least * usual(labelled, name)
    return judged.where((F.col(name) > 0) & (F.col(name) >= bound)).drop(name)
