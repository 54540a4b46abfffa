"""Source specs: "kind:argument" names a page set over a catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import titles
from pagelode.operators import activity, listing, pageset
from pagelode.sources.results import title_file

RECENT = 100


def _page(cat: listing.Catalog, title: str, default_ns: int = 0) -> DataFrame:
    """The page that a title names: its prefix gives the namespace, and its first letter may be either case."""
    t = titles.parse_one(title, {k.lower(): v for k, v in titles.NAMESPACES.items()}, frozenset(), frozenset(), False, default_ns)
    if t["kind"] != "local":
        raise ValueError(f"{title!r} is no title of a page here: {t['reason'] or t['kind']}")
    return cat["page"].where((F.col("ns") == t["ns"]) & F.col("title").isin(t["text"], t["text"][:1].upper() + t["text"][1:]))


def _id(cat: listing.Catalog, title: str, default_ns: int = 0) -> int:
    row = _page(cat, title, default_ns).orderBy("page_id").limit(1).collect()
    if not row:
        raise ValueError(f"no page titled {title!r}")
    return row[0]["page_id"]


KINDS: dict[str, Callable[[SparkSession, listing.Catalog, str], DataFrame]] = {
    "page": lambda s, c, a: _page(c, a),
    "cat": lambda s, c, a: listing.category_members(c, a, "page"),
    "subcats": lambda s, c, a: listing.category_members(c, a, "subcat"),
    "catfiles": lambda s, c, a: listing.category_members(c, a, "file"),
    "links": lambda s, c, a: listing.links_from(c, _id(c, a)),
    "backlinks": lambda s, c, a: listing.backlinks(c, _id(c, a)),
    "transcludes": lambda s, c, a: listing.transclusions(c, _id(c, a, 10)),
    "search": lambda s, c, a: listing.search(c, a),
    "prefix": lambda s, c, a: listing.all_pages(c, prefix=a),
    "allpages": lambda s, c, a: listing.all_pages(c, start=a or None),
    "special": lambda s, c, a: listing.special_page(c, a),
    "usercontribs": lambda s, c, a: c["page"].join(c["revision"].where(F.col("user") == a).select("page_id"), "page_id", "left_semi"),
    "recentchanges": lambda s, c, a: c["page"].join(activity.recent_changes(c["recentchanges"], limit=int(a) if a.isdigit() else RECENT).select("page_id"), "page_id", "left_semi"),
    "file": lambda s, c, a: c["page"].join(title_file(s, a), "title", "left_semi"),
}


def parse(spark: SparkSession, catalog: listing.Catalog, spec: str) -> DataFrame:
    kind, colon, argument = spec.partition(":")
    if not colon or kind.strip() not in KINDS:
        raise ValueError(f"bad source {spec!r}; kinds: {', '.join(KINDS)}")
    return KINDS[kind.strip()](spark, catalog, argument.strip())


def parse_all(spark: SparkSession, catalog: listing.Catalog, specs: Iterable[str]) -> DataFrame:
    """The pages of all specs, each once."""
    found = [parse(spark, catalog, s).select("page_id", "ns", "title") for s in specs]
    if not found:
        raise ValueError("no sources")
    return pageset.concat(*found).drop("source_no").transform(pageset.distinct_pages())
