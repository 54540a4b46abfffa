r"""Search by an inverted index.

An index is five tables under one path:

    postings   bucket, token, field, ns, part, alone, n_docs, occurrences; of some docs each row: docs, lengths, starts, positions
    counts     bucket, token, field, ns, docs, occurrences
    docs       field, ns, docs, words             one row for each field and ns
    several    doc_id, field                      of docs that have several rows in a field
    info       buckets

A token is a run of letters, marks, digits and underscores of any script, in lower case. A doc's text in a
field is one or several parts (the aliases of an entity), and a query's words must all be in one part.
postings and counts are split into folders by the token's hash, and each file is sorted by token, so a
query reads the buckets of its own words and there the row groups of its own words; it never reads texts.
Texts of about a block's words are inverted at once, as arrays, and give one posting row for each token: the ids and
lengths of its docs, and the positions of all, where those of a doc begin at its start. What a block has for
a bucket is shuffled as one packed value. Each text is split once.

A bucket with a very frequent token is dealt over several tasks and files by adaptive execution. Null
texts have no words, and count as docs. Null ids and repeated ids are rows like others; rows of one id,
field and part count as one text in a search. A query without words finds nothing.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelode.operators.entities import label
from pagelode.operators.pageset import in_namespaces

#: Whatever separates words; the same in Spark, and in SQL engines that know Unicode classes.
SEPARATOR = r"[^\p{L}\p{M}\p{N}_]+"
BUCKETS = 64
#: Words that are inverted at once, or those of one longer text.
BLOCK = 1 << 20
#: Spark's setting to remove an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What the docs of a posting row have in common.
KIND = ["field", "ns", "part", "alone"]
SORTS = {
    "relevance": ("score", False), "last_edit_desc": ("ts", False), "last_edit_asc": ("ts", True), "create_desc": ("created", False), "create_asc": ("created", True), "title": ("title", True), "none": ("page_id", True),
}


def words(text: Column) -> Column:
    """The tokens of a text in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def words_of_query(query: str) -> list[str]:
    """The tokens of a query, by the rule of words()."""
    return "".join(c if c == "_" or unicodedata.category(c)[0] in "LMN" else " " for c in query.lower()).split()


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


@dataclass
class Index:
    postings: DataFrame
    counts: DataFrame
    docs: DataFrame
    buckets: int


def build(texts: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> Index:
    """Writes an index of rows (doc_id, field, part, ns, text) and opens it."""
    spark = texts.sparkSession
    several = texts.where("doc_id is not null").groupBy("doc_id", "field").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "field")
    several.write.parquet(f"{path}/several")
    rows = _inverted(texts, spark.read.schema(several.schema).parquet(f"{path}/several"), buckets, block)
    _sorted(rows, f"{path}/postings", ["token", "field"])
    rows = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    counted = _counted(rows)
    _write(counted, f"{path}/counts", ["token", "field"])
    written = spark.read.schema(counted.schema).parquet(f"{path}/counts").groupBy("field", "ns").agg(F.sum("occurrences").alias("words"))
    per_doc = texts.groupBy("field", "ns").agg(F.countDistinct("doc_id").alias("docs")).alias("d")
    same = F.col("d.field").eqNullSafe(F.col("w.field")) & F.col("d.ns").eqNullSafe(F.col("w.ns"))
    per_doc.join(written.alias("w"), same, "left").select("d.field", "d.ns", "docs", F.coalesce("words", F.lit(0)).alias("words")).write.parquet(f"{path}/docs")
    spark.createDataFrame([(buckets, rows.schema.json(), counted.schema.json())], "buckets int, postings string, counts string").write.parquet(f"{path}/info")
    return open_(spark, path)


def _inverted(texts: DataFrame, several: DataFrame, buckets: int, block: int) -> DataFrame:
    """The rows of postings, dealt by bucket. alone: the docs have one row in the field."""
    of, again = texts.alias("t"), several.withColumn("again", F.lit(True)).alias("s")
    same = (F.col("t.doc_id") == F.col("s.doc_id")) & F.col("t.field").eqNullSafe(F.col("s.field"))
    alone = F.col("t.doc_id").isNotNull() & F.col("again").isNull()
    split = of.join(again, same, "left").select("t.doc_id", "t.field", "ns", "part", alone.alias("alone"), words(F.col("text")).alias("words"))
    packed = split.mapInArrow(_packer(buckets, block), "bucket int, packed binary")
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    rows = f"bucket int, token string, field {types['field']}, ns {types['ns']}, part {types['part']}, alone boolean, n_docs int, occurrences int, docs array<{types['doc_id']}>, lengths array<int>, starts array<int>, positions array<int>"
    return packed.hint("rebalance", "bucket").mapInArrow(_unpacked, rows)


def _packer(buckets: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column("words").offsets.to_numpy()[1:]
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
                yield from _block(b.slice(at, to - at), buckets)
                at = to

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packed in b.column("packed"):
            yield from pa.ipc.open_stream(packed.as_buffer())


def _block(b: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """The tokens of some texts with their docs and positions, by one stable sort, packed for each bucket."""
    offsets = b.column("words").offsets.to_numpy()
    length = np.diff(offsets)
    tokens = b.column("words").flatten().dictionary_encode()
    if not len(tokens):
        return
    bucket = np.array([zlib.crc32(t.as_buffer()) % buckets for t in tokens.dictionary], np.int32)
    by_token = pc.sort_indices(tokens.dictionary).to_numpy().astype(np.int64)
    by_bucket = by_token[np.argsort(bucket[by_token], kind="stable")]
    place = np.empty_like(by_bucket)
    place[by_bucket] = np.arange(len(by_bucket))
    row = np.repeat(np.arange(b.num_rows, dtype=np.int32), length)
    pos = np.arange(len(row), dtype=np.int32) - np.repeat((offsets[:-1] - offsets[0]).astype(np.int32), length)
    kind = np.zeros(b.num_rows, np.int64)
    for name in KIND:
        codes = b.column(name).dictionary_encode(null_encoding="encode")
        kind = np.unique(kind * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)[1]
    key = place[tokens.indices.to_numpy()] * np.int64(b.num_rows) + kind[row]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    new = np.r_[True, key[1:] != key[:-1]]
    docs = np.flatnonzero(new | np.r_[True, row[1:] != row[:-1]])  # where a doc of a token begins
    firsts = np.flatnonzero(new)
    doc_of = np.searchsorted(docs, firsts)
    to, doc_to = np.r_[firsts[1:], len(key)].astype(np.int32), np.r_[doc_of[1:], len(docs)].astype(np.int32)
    own, code = row[docs], by_bucket[key[firsts] // b.num_rows]
    listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)
    columns = {"bucket": pa.array(bucket[code]), "token": tokens.dictionary.take(pa.array(code))}
    columns |= {name: b.column(name).take(pa.array(row[firsts])) for name in KIND}
    columns |= {"n_docs": pa.array(np.diff(doc_to, prepend=np.int32(0))), "occurrences": pa.array(np.diff(to, prepend=np.int32(0)))}
    starts = (docs - np.repeat(firsts, columns["n_docs"].to_numpy())).astype(np.int32)
    columns |= {"docs": listed(doc_to, b.column("doc_id").take(pa.array(own))), "lengths": listed(doc_to, pa.array(length[own].astype(np.int32)))}
    columns |= {"starts": listed(doc_to, pa.array(starts)), "positions": listed(to, pa.array(pos[order]))}
    rows = pa.RecordBatch.from_pydict(columns)
    cuts = np.searchsorted(bucket[code], np.arange(buckets + 1))
    full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "packed": pa.array([_pack(rows.slice(cuts[k], cuts[k + 1] - cuts[k])) for k in full], pa.binary())})


def _pack(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def _counted(rows: DataFrame) -> DataFrame:
    """The counts of postings: docs that are alone in their field are added up, only ids of others are held against each other."""
    keys = ["bucket", "token", "field", "ns"]
    added = rows.select(*keys, F.when(F.col("alone"), F.col("n_docs")).otherwise(0).alias("docs"), "occurrences")
    other = rows.where("not alone").select(*keys, F.explode("docs").alias("doc_id")).where("doc_id is not null").distinct()
    return added.union(other.select(*keys, F.lit(1), F.lit(0))).groupBy(*keys).agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))


def _write(rows: DataFrame, path: str, order: list[str]) -> None:
    _sorted(rows.hint("rebalance", "bucket"), path, order)


def _sorted(rows: DataFrame, path: str, order: list[str]) -> None:
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        rows.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def open_(spark: SparkSession, path: str) -> Index:
    info = spark.read.parquet(f"{path}/info").first()
    # the schemas are given, as an empty table has no file to read them from
    postings, counts = (spark.read.schema(StructType.fromJson(json.loads(info[k]))).parquet(f"{path}/{k}") for k in ("postings", "counts"))
    return Index(postings, counts, spark.read.parquet(f"{path}/docs"), info.buckets)


def of_pages(pages: DataFrame) -> DataFrame:
    """What build() takes, from pages (page_id, ns, title, text): text and title in words, and the title as a whole for near matches."""
    fields = F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("text")), F.struct(F.lit("title").alias("field"), F.col("title").alias("text")))
    return pages.select(F.col("page_id").alias("doc_id"), F.inline(fields), F.lit(0).alias("part"), "ns")


def of_entities(entities: DataFrame) -> DataFrame:
    """What build() takes, from decoded entities: labels and aliases, a field for each language; part 0 is the label."""
    labels = F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("field"), F.lit(0).alias("part"), e["value"].alias("text")))
    listed = lambda e: F.transform(e["value"], lambda v, i: F.struct(e["key"].alias("field"), (i + 1).alias("part"), v.alias("text")))
    aliases = F.flatten(F.transform(F.map_entries("aliases"), listed))
    none = F.array().cast("array<struct<field:string,part:int,text:string>>")
    return entities.select(F.col("id").alias("doc_id"), F.col("kind").alias("ns"), F.inline(F.concat(F.coalesce(labels, none), F.coalesce(aliases, none))))


def _read(table: DataFrame, tokens: list[str], fields: Iterable[str], buckets: int) -> DataFrame:
    """The rows of some tokens: the conditions on buckets fold to constants, so that other folders aren't read."""
    asked = [(F.col("bucket") == bucket_of(F.lit(t), buckets)) & (F.col("token") == F.lit(t)) for t in tokens]
    return table.where(reduce(Column.__or__, asked) & F.col("field").isin(list(fields)))


def _entries() -> Column:
    """The docs of a posting row with their lengths and positions."""
    start = lambda i: F.get("starts", i)
    positions = lambda i: F.slice("positions", start(i) + 1, F.coalesce(start(i + 1), F.size("positions")) - start(i))
    return F.transform("docs", lambda d, i: F.struct(d.alias("doc_id"), F.get("lengths", i).alias("length"), positions(i).alias("positions")))


def matches(index: Index, query: str, fields: Iterable[str] = ("text",), namespaces: Iterable = (), phrase: bool = False) -> DataFrame:
    """(doc_id, field, part, ns, score): parts that hold all words of a query, one after the other if it is a phrase.

    The score is the sum over the words of tf (share of the part's words) times idf (log of 1 + docs over
    docs with the word), within the namespaces.
    """
    asked, fields = words_of_query(query), list(fields)
    tokens = list(dict.fromkeys(asked))
    space = list(namespaces)
    own = lambda df: df.where(F.col("ns").isin(space)) if space else df
    if not tokens:
        return index.postings.limit(0).select("field", "ns", "part", F.inline(_entries())).select("doc_id", "field", "part", "ns", F.lit(0.0).alias("score"))
    rows = _read(own(index.postings), tokens, fields, index.buckets).select("token", "field", "ns", "part", F.inline(_entries()))
    total = own(index.docs).where(F.col("field").isin(fields)).agg(F.coalesce(F.sum("docs"), F.lit(0))).scalar()
    have = _read(own(index.counts), tokens, fields, index.buckets).groupBy("token").agg(F.sum("docs").alias("docs"))
    # one row for each word of the query
    rated = rows.join(F.broadcast(have.select("token", F.log((1 + total) / F.col("docs")).alias("idf"))), "token")
    aggregates = [F.size(F.collect_set("token")).alias("found"), _added(F.size("positions") / F.col("length") * F.col("idf")).alias("score")]
    if phrase:
        aggregates.append(F.collect_list(F.struct("token", "positions")).alias("at"))
    found = rated.groupBy("doc_id", "field", "part", "ns").agg(*aggregates).where(F.col("found") == len(tokens))
    if phrase and len(asked) > 1:
        starts = [F.transform(F.flatten(F.filter("at", _is(t))["positions"]), _less(i)) for i, t in enumerate(asked)]
        found = found.where(F.size(reduce(F.array_intersect, starts)) > 0)
    return found.select("doc_id", "field", "part", "ns", "score")


def _added(value: Column) -> Column:
    """A sum in one order always, so that equal scores are equal."""
    return F.aggregate(F.sort_array(F.collect_list(value)), F.lit(0.0), lambda a, x: a + x)


def _is(token: str):
    return lambda x: x["token"] == token


def _less(n: int):
    return lambda p: p - n


def natural(title: Column) -> Column:
    """A key that orders titles as a reader does: numbers by their value, letters whatever their case."""
    parts = F.regexp_extract_all(F.lower(title), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.ltrim(p, F.lit("0")), 40, "0")).otherwise(p)), "")


def search(index: Index, pages: DataFrame, query: str, scope: str = "text", namespaces: Iterable[int] = (), sort: str = "relevance", phrase: bool = False, limit: int | None = None) -> DataFrame:
    """Pages (page_id, ns, title, ...) whose text or title holds all words of a query, with their score.

    near_match finds titles that are the query whatever their case: the title's words are looked up, and
    the few pages found are compared. Ties of the order go by page_id.
    """
    if scope not in ("text", "title", "near_match"):
        raise ValueError("scope must be text, title or near_match")
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {sorted(SORTS)}")
    field = "text" if scope == "text" else "title"
    hits = matches(index, query, [field], namespaces, phrase or scope == "near_match").select(F.col("doc_id").alias("page_id"), "score")
    rows = pages.transform(in_namespaces(namespaces)).join(hits, "page_id")
    if scope == "near_match":
        rows = rows.where(F.lower("title") == F.lower(F.lit(query)))
    column, up = SORTS[sort]
    key = natural(F.col("title")) if sort == "title" else F.col(column)
    rows = rows.orderBy(key.asc() if up else key.desc(), "page_id")
    return rows if limit is None else rows.limit(limit)


def search_entities(index: Index, entities: DataFrame, query: str, languages: Iterable[str] = ("en", "mul"), kind: str = "item", limit: int | None = None) -> DataFrame:
    """Entities whose label or alias in one of the languages holds all words of a query.

    (id, label, description, language, is_alias): the match counts that is in the first of the languages,
    there the label before aliases in their order. The label falls back to the one for all languages, the
    description doesn't. In order of languages, then labels first, then by score and id. Kinds that have
    no search raise.
    """
    if kind in ("mediainfo", "unknown"):
        raise ValueError(f"entities of kind {kind} can't be searched")
    chain = list(languages)
    place = F.array_position(F.array(*map(F.lit, chain)), F.col("field"))
    hits = matches(index, query, chain, [kind]).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct(place.alias("place"), "part", (-F.col("score")).alias("less"), "field")).alias("m"))
    rows = entities.where(F.col("kind") == kind).join(hits, "id")
    out = rows.select("id", label(F.col("labels"), chain[0]).alias("label"), F.try_element_at("descriptions", F.lit(chain[0])).alias("description"), F.col("m.field").alias("language"), (F.col("m.part") > 0).alias("is_alias"), "m")
    out = out.orderBy("m.place", "is_alias", "m.less", "id").drop("m")
    return out if limit is None else out.limit(limit)
