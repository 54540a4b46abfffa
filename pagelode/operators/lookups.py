"""Lookups of pages and files in a catalog of base tables, by joins.

    imagelinks      src_id, dst_id          pages and the files they show
    globalusage     wiki, page_id, title    uses of files on other wikis
    deleted_files   title, ts, ...
    iwlinks         page_id, prefix, title
    protections     page_id, action, level, expiry (null: never ends)
    proofread       page_id, level          scanned pages
    attributes      page_id, name, value    coordinates, images, extracts, items and the like

Null keys meet nothing. An asked row without an answer stays, with nulls, where that is said. Repeated
asked rows give repeated rows. Empty tables give empty tables. Bounds are inclusive.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pagelode.operators.listing import Catalog, _between, _top, latest_file
from pagelode.operators.pageset import in_namespaces

PAGE_SCHEMA = StructType([StructField("page_id", LongType()), StructField("ns", IntegerType()), StructField("title", StringType())])


def literal(spark, titles: Iterable[tuple[int, str]] = ()) -> DataFrame:
    """A page set (page_id, ns, title) of the titles given, with null ids; empty without titles."""
    return spark.createDataFrame([(None, ns, title) for ns, title in titles], PAGE_SCHEMA)


def found(asked: DataFrame, cat: Catalog) -> DataFrame:
    """(page_id, ns, title) of asked titles (a literal set), a row for each page of that title, with a null id if none has it."""
    return asked.select("ns", "title").join(cat["page"].select("page_id", "ns", "title"), ["ns", "title"], "left").select("page_id", "ns", "title")


def files(asked: DataFrame, cat: Catalog) -> DataFrame:
    """The asked titles with the newest upload of each, nulls where there is none."""
    return asked.join(latest_file(cat["file"]), "title", "left")


def file_usage(cat: Catalog, file_id: int, namespaces: Iterable[int] = ()) -> DataFrame:
    """Pages that show a file."""
    ids = cat["imagelinks"].where(F.col("dst_id") == file_id).select(F.col("src_id").alias("page_id"))
    return cat["page"].join(ids, "page_id", "left_semi").transform(in_namespaces(namespaces))


def global_usage(asked: DataFrame, cat: Catalog, own: str | None = None) -> DataFrame:
    """(title, wiki, page_id): uses of the asked files on all wikis, or on all but one's own."""
    rows = cat["globalusage"] if own is None else cat["globalusage"].where(F.col("wiki") != own)
    return rows.join(asked.select("title"), "title", "left_semi").select("title", "wiki", "page_id")


def deleted_files(cat: Catalog, start: str | None = None, end: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    rows = cat["deleted_files"].where(_between("title", start, end))
    if prefix:
        rows = rows.where(F.col("title").startswith(prefix))
    return _top(rows, [F.col("title"), F.col("ts")], limit)


def interwiki_links(cat: Catalog, page_id: int, prefix: str | None = None) -> DataFrame:
    """(prefix, title): distinct links of a page to other wikis."""
    rows = cat["iwlinks"].where(F.col("page_id") == page_id)
    return (rows.where(F.col("prefix") == prefix) if prefix else rows).select("prefix", "title").distinct()


def protections(asked: DataFrame, cat: Catalog, now: object) -> DataFrame:
    """(page_id, action, level, expiry) of the protections of asked pages that hold after now."""
    active = cat["protections"].where(F.col("expiry").isNull() | (F.col("expiry") > F.lit(now)))
    return active.join(asked.select("page_id"), "page_id", "left_semi").select("page_id", "action", "level", "expiry")


def tracking_categories(cat: Catalog) -> DataFrame:
    """(category, size): categories marked as tracking ones, with their members; size 0 without any."""
    marked = cat["tracking"].select("category").where("category is not null").distinct()
    sizes = cat["categorylinks"].groupBy("category").agg(F.count("*").alias("size"))
    return marked.join(sizes, "category", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def attributes(asked: DataFrame, cat: Catalog, name: str) -> DataFrame:
    """The asked pages with the values of one attribute, a row for each, null where a page has none."""
    return asked.join(cat["attributes"].where(F.col("name") == name).select("page_id", "value"), "page_id", "left")


def proofread_quality(asked: DataFrame, cat: Catalog) -> DataFrame:
    """(page_id, level) of the asked pages that are scanned pages."""
    return cat["proofread"].join(asked.select("page_id"), "page_id", "left_semi").select("page_id", "level")


def index_of(asked: DataFrame, cat: Catalog, index_ns: int) -> DataFrame:
    """(page_id, index_id): the index that transcludes a scanned page, the smallest of several, null without one."""
    indexes = cat["page"].where(F.col("ns") == index_ns).select(F.col("page_id").alias("src_id"))
    links = cat["templatelinks"].join(indexes, "src_id", "left_semi").groupBy(F.col("dst_id").alias("page_id")).agg(F.min("src_id").alias("index_id"))
    return asked.select("page_id").join(links, "page_id", "left")


def pages_of(cat: Catalog, index_id: int, page_ns: int) -> DataFrame:
    """(page_id, title, number): the scanned pages that an index transcludes; order them by number, then title.

    number is what follows the last slash of the title, null if it isn't a number.
    """
    ids = cat["templatelinks"].where(F.col("src_id") == index_id).select(F.col("dst_id").alias("page_id"))
    number = F.nullif(F.regexp_extract("title", r"/(\d{1,9})$", 1), F.lit("")).cast("int")
    return cat["page"].where(F.col("ns") == page_ns).join(ids, "page_id", "left_semi").select("page_id", "title", number.alias("number"))
