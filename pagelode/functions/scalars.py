"""Scalar functions over columns, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words for an expiry that never comes.
NEVER = ["infinity", "infinite", "indefinite", "never"]


def parse_timestamp(text: Column) -> Column:
    """ISO or 14-digit compact times, trimmed; null for all else."""
    t = F.trim(text)
    compact = F.when(t.rlike(r"^\d{14}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(t))
    return F.coalesce(compact, iso)


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_compact(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def is_never(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(NEVER)


def parse_expiry(text: Column) -> Column:
    """struct<never, at>."""
    return F.struct(F.coalesce(is_never(text), F.lit(False)).alias("never"), parse_timestamp(text).alias("at"))


def is_active_at(expiry: Column, when: Column) -> Column:
    return expiry["never"] | F.coalesce(expiry["at"] > when, F.lit(False))


def isbn_digits(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[\s\-\u2010-\u2015\u2212]", ""))


def _weighted(digits: Column, weights: list[int]) -> Column:
    parts = F.transform(F.split(digits, ""), lambda c: F.when(c == "X", F.lit(10)).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(parts, w, lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0), lambda acc, x: acc + x)


def isbn_valid(text: Column) -> Column:
    """ISBN-10 (modulo 11, X only last) or ISBN-13 (modulo 10, weights 1 and 3); false for null."""
    d = isbn_digits(text)
    ten = d.rlike(r"^\d{9}[\dX]$") & (_weighted(d, list(range(10, 0, -1))) % 11 == 0)
    thirteen = d.rlike(r"^97[89]\d{10}$") & (_weighted(d, [1, 3] * 6 + [1]) % 10 == 0)
    return F.coalesce(ten | thirteen, F.lit(False))


def to_isbn13(text: Column) -> Column:
    """The 13 digits of a valid ISBN; null for all else."""
    d = isbn_digits(text)
    stem = F.concat(F.lit("978"), F.substring(d, 1, 9))
    check = (10 - _weighted(stem, [1, 3] * 6) % 10) % 10
    return F.when(isbn_valid(text), F.when(F.length(d) == 13, d).otherwise(F.concat(stem, check.cast("string"))))


def redirect_target(text: Column) -> Column:
    """The target of a page that starts with a redirect; null for other pages."""
    # fixed value: the form of a redirect
    found = F.trim(F.regexp_extract(text, r"^\s*#[^\s\[]+\s*:?\s*\[\[([^\]|#\n]+)", 1))
    return F.when(found != "", found)


def project_of(server: Column) -> Column:
    """The project of a server's address: en.wikipedia of https://en.m.wikipedia.org; null outside the known domains."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(server)), r"^(?:[a-z]+:)?//", ""), r"[:/].*$", "")
    # the mobile label is the third from the end
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"(^|\.)m\.([^.]+\.[^.]+)$", "$1$2")
    known = host.rlike(r"(^|\.)(wikipedia|wiktionary|wikibooks|wikinews|wikiquote|wikisource|wikiversity|wikivoyage|wikimedia|wikidata|mediawiki|wikifunctions)\.org$")
    return F.when(known, F.regexp_replace(host, r"\.org$", ""))


def article_segment(title: Column) -> Column:
    """A title as a path segment: underscores for spaces, the rest percent-encoded in upper case."""
    e = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def hour_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def instant_of(hour: Column) -> Column:
    return F.when(hour.rlike(r"^\d{10}$"), F.try_to_timestamp(hour, F.lit("yyyyMMddHH")))


def temp_account_matches(name: Column, pattern: str) -> Column:
    """Whether a name has the form of a pattern in which $1 stands for anything."""
    before, _, after = pattern.partition("$1")
    return name.startswith(before) & name.endswith(after) & (F.length(name) > len(before) + len(after))


def ref_of(full_title: Column, ns: Column) -> Column:
    """The title without its prefix; titles of the main namespace keep a colon."""
    colon = F.locate(":", full_title)
    return F.when((ns == 0) | (colon == 0), full_title).otherwise(F.substring(full_title, colon + 1, F.length(full_title)))


def subject_ns(ns: Column) -> Column:
    """Virtual namespaces (below 0) are their own."""
    return F.when(ns < 0, ns).otherwise(ns - F.pmod(ns, F.lit(2)))


def talk_ns(ns: Column) -> Column:
    """Null for virtual namespaces."""
    return F.when(ns >= 0, ns - F.pmod(ns, F.lit(2)) + 1)


def first_upper(text: Column) -> Column:
    """First letter in upper case where that is one letter (ß stays)."""
    c = F.upper(F.substring(text, 1, 1))
    return F.when(F.length(c) == 1, F.concat(c, F.substring(text, 2, 1 << 30))).otherwise(text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; Spark's length() counts code points."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def site_link(prefix: Column, title: Column, label: Column | None = None) -> Column:
    """[[:prefix:title]] or [[:prefix:title|label]]."""
    end = F.lit("]]") if label is None else F.concat(F.lit("|"), label, F.lit("]]"))
    return F.concat(F.lit("[[:"), prefix, F.lit(":"), title, end)


def retry_delay(attempt: Column, first: float = 1.0, cap: float = 120.0, server: Column | None = None) -> Column:
    """Seconds before an attempt: doubling up to a cap, never less than the server asks for."""
    own = F.least(F.lit(cap), first * F.pow(F.lit(2.0), attempt - 1))
    return own if server is None else F.greatest(own, F.coalesce(server, F.lit(0.0)))


def quality_level(level: Column) -> Column:
    """Proofreading levels 0 to 4 by name."""
    names = ["without_text", "not_proofread", "problematic", "proofread", "validated"]
    return F.get(F.array(*map(F.lit, names)), level.cast("int"))


def matches(text: Column, pattern: str) -> Column:
    """array<string> of a pattern's matches in order. Null for null."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def placed_matches(text: Column, pattern: str, hits: Column | None = None) -> Column:
    """array<struct<start, text>> of a pattern's matches in order; start counts code points. Null for null.

    hits are the matches of that text where they are a column already, so that they aren't looked for again.
    """
    # a match begins after all that stands between matches before it, and those matches
    between = F.split(text, pattern)
    if hits is None:
        hits = matches(text, pattern)
    else:
        between = F.when(F.size(hits) == 0, F.array().cast("array<string>")).otherwise(between)
    sizes = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda a, b: F.struct(F.char_length(a).alias("gap"), b.alias("text")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + F.char_length(x["text"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["text"].alias("text")))).alias("out"))
    return F.aggregate(sizes, empty, step)["out"]
