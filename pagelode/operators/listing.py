"""Listing queries over a catalog of base tables.

A catalog is a mapping of table names to DataFrames:

    page            page_id, ns, title, is_redirect, ...
    links           src_id, dst_id          (page, template, file and redirect links share this shape)
    categorylinks   page_id, category, sortkey, type ('page', 'subcat', 'file'), ts
    revision        rev_id, page_id, parent_id, ts, user, size, text, tags
    recentchanges   rc_id, ts, page_id, user, type, ns, flags ...

Bounds are inclusive. An empty set of namespaces means all. limit None means no limit; with an order
and a limit Spark keeps only the first rows of each partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.operators.diffs import with_parent
from pagelode.operators.pageset import in_namespaces

Catalog = Mapping[str, DataFrame]


def _top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def _between(column: str, start: object | None, end: object | None, descending: bool = False) -> Column:
    """Inclusive bounds; with descending order they change roles."""
    if descending:
        start, end = end, start
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(column) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(column) <= F.lit(end))
    return cond


def show(flags: Mapping[str, bool | None]) -> Column:
    """A predicate from tri-state flags: true, false, or unset."""
    cond = F.lit(True)
    for name, on in flags.items():
        if on is not None:
            cond = cond & (F.col(name) if on else ~F.col(name))
    return cond


def parse_flags(text: str) -> dict[str, bool]:
    """Flags from their text form: a|!b."""
    return {p.lstrip("!"): not p.startswith("!") for p in text.split("|") if p}


def category_members(cat: Catalog, category: str, kind: str | None = None, namespaces: Iterable[int] = (), sort: str = "sortkey", start_sort_key: str | None = None, limit: int | None = None) -> DataFrame:
    if sort not in ("sortkey", "timestamp"):
        raise ValueError("sort must be sortkey or timestamp")
    own = cat["categorylinks"].where(F.col("category") == category)
    if kind:
        own = own.where(F.col("type") == kind)
    if start_sort_key is not None:
        own = own.where(F.col("sortkey") >= start_sort_key)
    rows = own.join(cat["page"], "page_id").transform(in_namespaces(namespaces))
    order = ["sortkey", "page_id"] if sort == "sortkey" else ["ts", "page_id"]
    return _top(rows, [F.col(c) for c in order], limit)


def backlinks(cat: Catalog, target_id: int, namespaces: Iterable[int] = (), include_redirects: bool = True) -> DataFrame:
    """Pages that link to a page, and through one redirect to it."""
    links = cat["links"].select("src_id", "dst_id")
    direct = links.where(F.col("dst_id") == target_id).select("src_id")
    if include_redirects:
        via = cat["redirect"].where(F.col("dst_id") == target_id).select(F.col("src_id").alias("dst_id"))
        direct = direct.unionByName(links.join(via, "dst_id").select("src_id"))
    ids = direct.select(F.col("src_id").alias("page_id")).distinct()
    return cat["page"].join(ids, "page_id", "left_semi").transform(in_namespaces(namespaces))


def transclusions(cat: Catalog, template_id: int, namespaces: Iterable[int] = ()) -> DataFrame:
    ids = cat["templatelinks"].where(F.col("dst_id") == template_id).select(F.col("src_id").alias("page_id"))
    return cat["page"].join(ids, "page_id", "left_semi").transform(in_namespaces(namespaces))


def links_from(cat: Catalog, page_id: int, table: str = "links", namespaces: Iterable[int] = ()) -> DataFrame:
    """Pages that a page links to, transcludes (templatelinks) or shows (imagelinks)."""
    ids = cat[table].where(F.col("src_id") == page_id).select(F.col("dst_id").alias("page_id"))
    return cat["page"].join(ids, "page_id", "left_semi").transform(in_namespaces(namespaces))


def categories_of(cat: Catalog, page_id: int) -> DataFrame:
    return cat["categorylinks"].where(F.col("page_id") == page_id).select("category").distinct()


def outside_links_on(cat: Catalog, page_id: int, table: str) -> DataFrame:
    """langlinks (a blank language is dropped), iwlinks or externallinks of a page."""
    rows = cat[table].where(F.col("page_id") == page_id)
    return rows.where(F.trim("lang") != "") if table == "langlinks" else rows


def all_pages(cat: Catalog, namespace: int = 0, start: str | None = None, end: str | None = None, prefix: str | None = None, descending: bool = False, redirects: str = "all", limit: int | None = None) -> DataFrame:
    rows = cat["page"].where((F.col("ns") == namespace) & _between("title", start, end, descending))
    if prefix:
        rows = rows.where(F.col("title").startswith(prefix))
    if redirects != "all":
        rows = rows.where(F.col("is_redirect") == (redirects == "only"))
    return _top(rows, [F.desc("title") if descending else F.asc("title"), F.col("page_id")], limit)


def all_categories(cat: Catalog, start: str | None = None, end: str | None = None, prefix: str | None = None, least: int | None = None, most: int | None = None, limit: int | None = None) -> DataFrame:
    rows = cat["categorylinks"].where(_between("category", start, end))
    if prefix:
        rows = rows.where(F.col("category").startswith(prefix))
    sums = rows.groupBy("category").agg(F.count("*").alias("size")).where(_between("size", least, most))
    return _top(sums, [F.col("category")], limit)


def all_targets(cat: Catalog, table: str = "links", unique: bool = True, start: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Link, redirect, transclusion or file targets, by title."""
    rows = cat[table].join(cat["page"].select(F.col("page_id").alias("dst_id"), "ns", "title"), "dst_id").select("ns", "title").where(_between("title", start, None))
    if prefix:
        rows = rows.where(F.col("title").startswith(prefix))
    return _top(rows.distinct() if unique else rows, [F.col("title"), F.col("ns")], limit)


def prefix_search(cat: Catalog, query: str, namespaces: Iterable[int] = (), limit: int | None = None) -> DataFrame:
    """First-letter case is ignored, as titles start in upper case."""
    hit = F.col("title").startswith(query) | F.col("title").startswith(query[:1].upper() + query[1:])
    return _top(cat["page"].where(hit).transform(in_namespaces(namespaces)), [F.col("title"), F.col("page_id")], limit)


SEARCH_SORTS = {
    "last_edit_desc": F.desc, "last_edit_asc": F.asc, "create_desc": F.desc, "create_asc": F.asc, "none": F.asc,
}


def search(cat: Catalog, query: str, scope: str = "text", namespaces: Iterable[int] = (), sort: str = "relevance", limit: int | None = None) -> DataFrame:
    """Pages whose text or title holds all words of the query, whatever their case and script, by a scan of the texts.

    operators/search.py answers the same from an index.

    Relevance is the sum over the words of tf (share of the page's words) times idf (log of 1 + pages over
    pages with the word); a wiki's own ranking isn't defined outside it.
    """
    if scope not in ("text", "title", "near_match"):
        raise ValueError("scope must be text, title or near_match")
    rows = cat["content"].transform(in_namespaces(namespaces))
    if scope == "near_match":
        return _top(rows.where(F.lower("title") == query.lower()), [F.col("page_id")], limit)
    words = query.lower().split()
    found = F.split(F.lower(F.coalesce(F.col("text" if scope == "text" else "title"), F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+")
    rows = rows.withColumn("_words", found)
    for w in words:
        rows = rows.where(F.array_contains("_words", w))
    if sort != "relevance":
        if sort not in SEARCH_SORTS:
            raise ValueError(f"sort must be relevance or one of {sorted(SEARCH_SORTS)}")
        column = "ts" if "edit" in sort else "created" if "create" in sort else "page_id"
        return _top(rows.drop("_words"), [SEARCH_SORTS[sort](column), F.col("page_id")], limit)
    if not words:
        return _top(rows.withColumn("score", F.lit(0.0)).drop("_words"), [F.col("page_id")], limit)
    # one aggregate gives the count of pages and how many have each word
    every = cat["content"].transform(in_namespaces(namespaces)).select(found.alias("_words"))
    n, *have = every.agg(F.count("*"), *[F.count_if(F.array_contains("_words", w)) for w in words]).collect()[0]

    def share(word: str) -> Column:
        return F.size(F.filter("_words", lambda x: x == word)) / F.size("_words")

    score = sum((share(w) * F.log(F.lit((1 + n) / max(1, df))) for w, df in zip(words, have)), F.lit(0.0))
    return _top(rows.withColumn("score", score).drop("_words"), [F.desc("score"), F.col("page_id")], limit)


def special_page(cat: Catalog, name: str, limit: int | None = None) -> DataFrame:
    """Lonelypages, Deadendpages, Uncategorizedpages, Wantedcategories, Mostlinked, Shortpages, Longpages."""
    page = cat["page"]
    if name == "Lonelypages":
        rows = page.where("not is_redirect").join(cat["links"].select(F.col("dst_id").alias("page_id")), "page_id", "left_anti")
        return _top(rows, [F.col("title"), F.col("page_id")], limit)
    if name == "Deadendpages":
        rows = page.where("not is_redirect").join(cat["links"].select(F.col("src_id").alias("page_id")), "page_id", "left_anti")
        return _top(rows, [F.col("title"), F.col("page_id")], limit)
    if name == "Uncategorizedpages":
        rows = page.where("not is_redirect").join(cat["categorylinks"].select("page_id"), "page_id", "left_anti")
        return _top(rows, [F.col("title"), F.col("page_id")], limit)
    if name == "Wantedcategories":
        have = page.where("ns = 14").select(F.col("title").alias("category"))
        rows = cat["categorylinks"].join(have, "category", "left_anti").groupBy("category").agg(F.count("*").alias("size"))
        return _top(rows, [F.desc("size"), F.col("category")], limit)
    if name == "Mostlinked":
        rows = cat["links"].groupBy(F.col("dst_id").alias("page_id")).agg(F.count("*").alias("size")).join(page, "page_id")
        return _top(rows, [F.desc("size"), F.col("page_id")], limit)
    if name in ("Shortpages", "Longpages"):
        return _top(page.where("not is_redirect"), [F.asc("len") if name == "Shortpages" else F.desc("len"), F.col("page_id")], limit)
    raise ValueError(f"unknown special page {name}")


def external_link_usage(cat: Catalog, host: str, protocol: str | None = None, path_prefix: str = "", limit: int | None = None) -> DataFrame:
    """Pages with links to a host; http and https are told apart where a protocol is given."""
    url = F.col("url")
    rows = cat["externallinks"].where(F.try_parse_url(url, F.lit("HOST")) == host)
    if protocol:
        rows = rows.where(F.try_parse_url(url, F.lit("PROTOCOL")) == protocol)
    if path_prefix:
        rows = rows.where(F.try_parse_url(url, F.lit("PATH")).startswith(path_prefix))
    return _top(rows, [F.col("page_id"), url], limit)


def random_pages(cat: Catalog, n: int, namespaces: Iterable[int] = (), seed: int = 0) -> DataFrame:
    """n pages; a sampling operator, so the limit is the feature."""
    return cat["page"].transform(in_namespaces(namespaces)).orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(n)


def watchlist(cat: Catalog, user: object, namespaces: Iterable[int] = ()) -> DataFrame:
    own = cat["watchlist"].where(F.col("user") == user).select("page_id")
    return cat["page"].join(own, "page_id", "left_semi").transform(in_namespaces(namespaces))


def pages_with_property(cat: Catalog, name: str) -> DataFrame:
    return cat["page"].join(cat["page_props"].where(F.col("property") == name).select("page_id"), "page_id", "left_semi")


def protected_titles(cat: Catalog, namespaces: Iterable[int] = (), level: str | None = None) -> DataFrame:
    rows = cat["protected_titles"].transform(in_namespaces(namespaces))
    return rows.where(F.col("level") == level) if level else rows


def sources_of(asked: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, sources): for every asked page the sorted pages that link to it, empty if none."""
    hits = links.join(asked.select(F.col("page_id").alias("dst_id")), "dst_id", "left_semi")
    lists = hits.groupBy(F.col("dst_id").alias("page_id")).agg(F.sort_array(F.collect_set("src_id")).alias("sources"))
    return asked.join(lists, "page_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(lists.schema["sources"].dataType)))


def contributors(revisions: DataFrame) -> DataFrame:
    """(page_id, users, n_users, n_anonymous): a null user is anonymous."""
    return revisions.groupBy("page_id").agg(
        F.sort_array(F.collect_set("user")).alias("users"),
        F.countDistinct("user").alias("n_users"),
        F.sum(F.col("user").isNull().cast("long")).alias("n_anonymous"),
    )


def category_info(cat: Catalog) -> DataFrame:
    """(category, size, pages, files, subcats)."""
    n = lambda k: F.sum((F.col("type") == k).cast("long"))
    return cat["categorylinks"].groupBy("category").agg(F.count("*").alias("size"), n("page").alias("pages"), n("file").alias("files"), n("subcat").alias("subcats"))


def exists(asked: DataFrame, cat: Catalog) -> DataFrame:
    """The asked pages with found: whether the title is a page's."""
    have = cat["page"].select("ns", "title").distinct().withColumn("found", F.lit(True))
    return asked.join(have, ["ns", "title"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def template_names(cat: Catalog, template_id: int) -> DataFrame:
    """A template's own title and those of the redirects to it."""
    ids = cat["redirect"].where(F.col("dst_id") == template_id).select(F.col("src_id").alias("page_id"))
    return cat["page"].where((F.col("page_id") == template_id)).unionByName(cat["page"].join(ids, "page_id", "left_semi")).select("title").distinct()


def all_users(cat: Catalog, start: str | None = None, end: str | None = None, prefix: str | None = None, groups: Iterable[str] = (), with_edits_only: bool = False, limit: int | None = None) -> DataFrame:
    rows = cat["user"].where(_between("name", start, end))
    if prefix:
        rows = rows.where(F.col("name").startswith(prefix))
    wanted = list(groups)
    if wanted:
        rows = rows.where(F.arrays_overlap("groups", F.array(*map(F.lit, wanted))))
    if with_edits_only:
        rows = rows.where("edits > 0")
    return _top(rows, [F.col("name")], limit)


def blocks(cat: Catalog, users: Iterable[str] = (), start: object | None = None, end: object | None = None, flags: Mapping[str, bool | None] | None = None, limit: int | None = None) -> DataFrame:
    rows = cat["block"].where(_between("ts", start, end) & show(flags or {}))
    own = list(users)
    return _top(rows.where(F.col("user").isin(own)) if own else rows, [F.desc("ts"), F.desc("block_id")], limit)


def duplicates_of(files: DataFrame) -> DataFrame:
    """(sha1, files): hashes that two files or more share."""
    return files.groupBy("sha1").agg(F.sort_array(F.collect_set("title")).alias("files")).where(F.size("files") > 1)


def latest_file(files: DataFrame) -> DataFrame:
    """One row for each title: the newest upload, by id among equal times."""
    rest = [c for c in files.columns if c not in ("title", "ts", "file_id")]
    last = files.groupBy("title").agg(F.max(F.struct("ts", "file_id", *rest)).alias("_last"))
    return last.select("title", "_last.*")


EARTH = 6_371_000.0


def nearby(points: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Points (lat, lon) within a radius in metres: a box first, then the great circle."""
    from math import cos, degrees, radians

    dlat = degrees(radius / EARTH)
    # a circle about a pole has all longitudes
    dlon = 180.0 if abs(lat) + dlat >= 89.9 else min(180.0, dlat / cos(radians(abs(lat) + dlat)))
    # near the antimeridian the box's longitudes wrap
    apart = F.abs(F.pmod(F.col("lon") - lon + 180.0, F.lit(360.0)) - 180.0)
    a = F.pow(F.sin(F.radians(F.col("lat") - lat) / 2), 2) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians("lat")) * F.pow(F.sin(F.radians(F.col("lon") - lon) / 2), 2)
    distance = 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    return points.where(F.col("lat").between(lat - dlat, lat + dlat) & (apart <= dlon)).withColumn("distance", distance).where(F.col("distance") <= radius)


def new_page_stats(rows: DataFrame) -> DataFrame:
    """Triage counts and the oldest unreviewed page."""
    return rows.agg(
        F.count("*").alias("pages"),
        F.sum(F.col("reviewed").cast("long")).alias("reviewed"),
        F.sum((~F.col("reviewed")).cast("long")).alias("unreviewed"),
        F.min(F.when(~F.col("reviewed"), F.col("ts"))).alias("oldest"),
    )


def with_size_change(revisions: DataFrame) -> DataFrame:
    """Adds parent_id and size_change: the size less that of the page's revision before."""
    before = "size_before" + "_" * sum(c.lower().startswith("size_before") for c in revisions.columns)
    return with_parent(revisions, **{before: "size"}).withColumn("size_change", F.col("size") - F.coalesce(before, F.lit(0))).drop(before)
