"""XML dumps of pages: plain, gzip or bzip2 by file name, read in parallel.

Files are cut at </page>, which Spark does inside a plain or bzip2 file too. A record is cut at its
first </revision>, so a history dump gives each page's first revision and long histories cost no
memory. Namespaces are filtered on the raw text, before any XML is parsed. A page that isn't well
formed, or a byte sequence that isn't UTF-8 where a page has it in its XML, fails the job.

A dump is read once. Damage that only the whole file shows (cut off, a document type, a page over a size)
is counted by the scan itself, as observed metrics, and judged when the read has ended.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PAGE = r"<page[\s>]"
SCHEMA = """title string, ns int, id long, redirect struct<_title:string>, revision struct<id:long, parentid:long, timestamp:string,
    contributor:struct<username:string, ip:string, id:long>, comment:string, model:string, format:string, text:struct<_VALUE:string, _bytes:long>, sha1:string>"""


class DumpFormatError(ValueError):
    """A dump that is cut off or that declares a document type."""


#: Characters of a page's XML, at most.
LARGEST = 100_000_000


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): what ends with </page>. block is where the file's split begins and place
    counts up inside it, so that (file, block, place) is the order of a sequential read."""
    own = spark.read.option("lineSep", "</page>").text(path)
    return own.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "value")


@dataclass
class Dump:
    """pages, and what their read has seen of damage: judge() after an action over all of them."""

    pages: DataFrame
    seen: Observation
    files: list[str]

    def judge(self) -> None:
        """Raise if a file declares a document type or doesn't end, after its last page, with </mediawiki>. Waits for the first action."""
        got = self.seen.get
        names = [unquote(f).rsplit("/", 1)[-1] for f in self.files]
        for wrong, what in ((got["dtd"], "declares a document type"), (got["odd"], "has an end tag with a space"), (got["large"], f"has a page of over {LARGEST} characters"), (got["letters"], "isn't UTF-8")):
            if wrong is not None:
                raise DumpFormatError(f"{wrong}: {what}")
        if (got["ends"] or 0, got["ended"] or 0) != (len(names), sum(zlib.crc32(n.encode()) for n in names)):
            raise DumpFormatError(f"{got['ends'] or 0} of {len(names)} files end with </mediawiki>: the others are cut off")

    def saved(self, path: str) -> DataFrame:
        """The pages written as Parquet by the one read, and judged."""
        self.pages.write.parquet(path)
        self.judge()
        return self.pages.sparkSession.read.parquet(path)


def read(spark: SparkSession, path: str, namespaces: Iterable[int] = ()) -> Dump:
    """Pages as by pages(), whose one scan also counts damage."""
    value, name = F.col("value"), F.element_at(F.split("file", "/"), -1)
    own, seen = fragments(spark, path), Observation()
    page = value.rlike(PAGE)
    end = value.contains("</mediawiki>") & ~page
    which = lambda bad: F.max(F.when(bad, F.col("file")))
    own = own.observe(
        seen, F.count_if(end).alias("ends"), F.sum(F.when(end, F.crc32(F.url_decode(name).cast("binary")))).alias("ended"), which(value.rlike(r"^\s*(?:<\?[^>]*>\s*)?<!DOCTYPE")).alias("dtd"),
        which(value.contains("</page ")).alias("odd"), which(page & (F.length(value) > LARGEST)).alias("large"), which(~F.is_valid_utf8(value)).alias("letters"),
    )
    return Dump(_parsed(own, namespaces), seen, spark.read.text(path).inputFiles())


def pages(spark: SparkSession, path: str, namespaces: Iterable[int] = ()) -> DataFrame:
    """One row for each page: page_id, ns, title, redirect, rev_id, parent_id, ts, user, comment, model, text, sha1, file, block, place."""
    return _parsed(fragments(spark, path), namespaces)


def _parsed(own: DataFrame, namespaces: Iterable[int]) -> DataFrame:
    own = own.where(F.col("value").rlike(PAGE))
    wanted = sorted(set(namespaces))
    if wanted:
        own = own.where(F.regexp_extract("value", r"<ns>\s*(-?\d+)\s*</ns>", 1).isin([str(n) for n in wanted]))
    start = F.substring("value", F.regexp_instr("value", F.lit(PAGE)), F.lit(2_000_000_000))
    cut = F.locate("</revision>", start)
    xml = F.when(cut > 0, F.concat(F.substring(start, F.lit(1), cut - 1), F.lit("</revision></page>"))).otherwise(F.concat(start, F.lit("</page>")))
    p = own.select("file", "block", "place", F.from_xml(xml, SCHEMA, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}).alias("p"))
    r = "p.revision"
    return p.select(
        F.col("p.id").alias("page_id"), F.col("p.ns").alias("ns"), F.col("p.title").alias("title"), F.col("p.redirect._title").alias("redirect"),
        F.col(f"{r}.id").alias("rev_id"), F.col(f"{r}.parentid").alias("parent_id"), F.try_to_timestamp(f"{r}.timestamp").alias("ts"),
        F.coalesce(f"{r}.contributor.username", f"{r}.contributor.ip").alias("user"), F.col(f"{r}.comment").alias("comment"), F.col(f"{r}.model").alias("model"),
        F.coalesce(f"{r}.text._VALUE", F.lit("")).alias("text"), F.col(f"{r}.sha1").alias("sha1"), "file", "block", "place",
    )


def escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    # characters that XML can't hold
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")


def to_xml(rows: DataFrame) -> DataFrame:
    """The XML of pages (page_id, ns, title, text), one value for each; write with a header and a footer around."""
    return rows.select(
        F.concat(
            F.lit("  <page>\n    <title>"), escaped(F.col("title")), F.lit("</title>\n    <ns>"), F.col("ns").cast("string"), F.lit("</ns>\n    <id>"), F.col("page_id").cast("string"),
            F.lit("</id>\n    <revision>\n      <id>"), F.col("page_id").cast("string"), F.lit('</id>\n      <text bytes="'), F.octet_length("text").cast("string"),
            F.lit('" xml:space="preserve">'), escaped(F.col("text")), F.lit("</text>\n    </revision>\n  </page>"),
        ).alias("value")
    )


def write(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Write pages as a folder of dumps, each whole in itself."""

    def wrapped(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["<mediawiki>"])], names=["value"])
        for b in batches:
            yield b
        yield pa.RecordBatch.from_arrays([pa.array(["</mediawiki>"])], names=["value"])

    to_xml(rows).mapInArrow(wrapped, "value string").write.option("compression", compression).text(path)
