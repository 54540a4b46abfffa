"""Results of a query service, title files and title lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = "struct<value:string, type:string, language:string, datatype:string>"


def sparql_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """One row for each binding: row map<string, struct<value, type, language, datatype>>; an unbound variable is no key."""
    schema = "results struct<bindings:array<map<string,struct<value:string, type:string, `xml:lang`:string, datatype:string>>>>"
    b = rows.select(F.explode(F.from_json(column, schema)["results"]["bindings"]).alias("b"))
    return b.select(F.transform_values("b", lambda k, v: F.struct(v["value"].alias("value"), v["type"].alias("type"), v["xml:lang"].alias("language"), v["datatype"].alias("datatype"))).alias("row"))


def unescape(text: Column) -> Column:
    """Backslash escapes, read once from left to right."""
    marked = F.replace(text, F.lit("\\\\"), F.lit("\ue000"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"')):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return F.replace(marked, F.lit("\ue000"), F.lit("\\"))


def term(cell: Column) -> Column:
    """A cell of a TSV result: <uri>, _:node, "text"@language, "text"^^<type> or a bare literal; null if empty."""
    quoted = F.regexp_extract(cell, r'^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    some = lambda c: F.when(c != "", c)
    make = lambda value, kind, lang=F.lit(None), dtype=F.lit(None): F.struct(value.alias("value"), F.lit(kind).alias("type"), lang.cast("string").alias("language"), dtype.cast("string").alias("datatype"))
    return (
        F.when(cell == "", F.lit(None).cast(_TERM))
        .when(cell.rlike(r"^<.*>$"), make(F.substring(cell, F.lit(2), F.length(cell) - 2), "uri"))
        .when(cell.startswith("_:"), make(F.substring(cell, F.lit(3), F.length(cell)), "bnode"))
        .when(cell.startswith('"'), make(unescape(quoted), "literal", some(F.regexp_extract(cell, r'"@([A-Za-z0-9-]+)$', 1)), some(F.regexp_extract(cell, r'"\^\^<([^>]*)>$', 1))))
        .otherwise(make(cell, "literal"))
    )


def sparql_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from a TSV file, whose first line names the variables."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("?")).limit(1).collect()
    names = [n.lstrip("?") for n in header[0][0].split("\t")] if header else []
    cells = F.transform(F.split("value", "\t"), term)
    row = F.map_from_arrays(F.array(*map(F.lit, names)), cells) if names else F.lit(None)
    body = lines.where((F.col("value") != header[0][0]) & (F.col("value") != "")) if header else lines.where("false")
    return body.select(F.map_filter(row, lambda k, v: v.isNotNull()).alias("row"))


def entity_ids(rows: DataFrame, variable: str) -> DataFrame:
    """(id) of entities that a variable is bound to."""
    v = F.try_element_at("row", F.lit(variable))
    found = F.regexp_extract(v["value"], r"/entity/([QPL]\d+)$", 1)
    return rows.where(v["type"] == "uri").select(found.alias("id")).where("id != ''")


def title_file(spark: SparkSession, path: str) -> DataFrame:
    """(title) of each line: trimmed; blank lines and those that start with # are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("title")).where("title != '' and not startswith(title, '#')")


def title_list(titles: DataFrame, parsed: Column) -> tuple[DataFrame, DataFrame]:
    """(pages, dropped): local titles, and one row that counts those that are invalid or elsewhere."""
    own = titles.withColumn("t", parsed)
    pages = own.where("t.kind = 'local'").select(F.col("t.ns").alias("ns"), F.col("t.text").alias("title"))
    dropped = own.agg(F.coalesce(F.sum((F.col("t.kind") == "invalid").cast("long")), F.lit(0)).alias("invalid"), F.coalesce(F.sum((F.col("t.kind") == "interwiki").cast("long")), F.lit(0)).alias("elsewhere"))
    return pages, dropped
