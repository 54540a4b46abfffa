"""A query for each operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions import dates, scalars, titles, wikitext
from pagelode.operators import activity, diffs, edits, entities, extensions, listing, lookups, pageset, runs, search, timeseries
from pagelode.plans.wiki import Catalog, with_views
from pagelode.session import settled, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, also: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, and by another one that it had."""

    def add(f: Query) -> Query:
        for name in (f.__name__, also):
            if name:
                QUERIES[name] = f
                if sql:
                    SQL[name] = with_views(sql)
        return f

    return add


def _holds(column: str, *words: str) -> str:
    """SQL for a text that has all words, in any script."""
    return " and ".join(f"list_contains(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), '{w}')" for w in words)


PAGE = ("page_id", "ns", "title")

# --- flagship ---------------------------------------------------------------------------------


@query("""select event_type, count(*) as n, cast(sum(case when quality = 1 then 1 else 0 end) as bigint) as good from (
    select e.*, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events e where event_type in ('click', 'purchase')) e
    left join labels l on l.doc_id = e.user_id where rn = 1 and user_id not in (select doc_id from labels where toxic = 1) group by event_type""")
def recent_activity(spark, sf):
    """The newest row of each user for two event types, without excluded users, counted by type."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "ts", "user_id", "event_type")
    newest = activity.latest_of(e, ["user_id", "event_type"], "ts", "event_id")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "user_id")
    kept = newest.join(labels.where("toxic = 1").select("user_id"), "user_id", "left_anti").join(labels.select("user_id", "quality"), "user_id", "left")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"))


# --- page-set algebra -------------------------------------------------------------------------


@query("select page_id, ns, title from v_page where ns in (0, 2)")
def filter_namespaces(spark, sf):
    return Catalog(spark, sf)["page"].transform(pageset.in_namespaces([0, 2])).select(*PAGE)


@query("select ns, count(*) as n from v_page group by ns")
def filter_namespaces_empty(spark, sf):
    return Catalog(spark, sf)["page"].transform(pageset.in_namespaces([])).groupBy("ns").agg(F.count("*").alias("n"))


@query("select page_id, title from v_page where regexp_matches(title, 'r[ei]d?/')")
def title_matching(spark, sf):
    return Catalog(spark, sf)["page"].transform(pageset.title_matching("r[ei]d?/")).select("page_id", "title")


@query("select page_id, title from v_page where not regexp_matches(title, '[13]$')")
def title_not_matching(spark, sf):
    return Catalog(spark, sf)["page"].transform(pageset.title_matching("[13]$", negate=True)).select("page_id", "title")


@query("select page_id, ns, title from (select *, row_number() over (partition by ns, title order by page_id) as rn from v_page) where rn = 1")
def distinct_pages(spark, sf):
    return Catalog(spark, sf)["page"].select(*PAGE).transform(pageset.distinct_pages("page_id"))


@query("select page_id, title from v_page where length(title) - length(replace(title, '/', '')) <= 0")
def subpage_depth(spark, sf):
    return Catalog(spark, sf)["page"].transform(pageset.subpage_depth_at_most(0)).select("page_id", "title")


@query("select src_id, ns, title from v_links join v_page on page_id = dst_id where (ns, title) in (select (ns, title) from v_page where is_redirect)")
def intersect_pages(spark, sf):
    c = Catalog(spark, sf)
    linked = c["links"].join(c["page"], F.col("page_id") == F.col("dst_id")).select("src_id", "ns", "title")
    return linked.transform(pageset.intersect(c["page"].where("is_redirect")))


@query("select p.page_id, p.title from v_page p where not exists (select 1 from v_page r where r.is_redirect and r.ns = p.ns and r.title = p.title)")
def exclude_pages(spark, sf):
    p = Catalog(spark, sf)["page"]
    return p.transform(pageset.excluding(p.where("is_redirect"))).select("page_id", "title")


@query("select 0 as source_no, page_id from v_page where ns = 0 union all select 1, page_id from v_page where len > 25")
def concat_pages(spark, sf):
    p = Catalog(spark, sf)["page"].select("page_id", "ns", "len")
    return pageset.concat(p.where("ns = 0"), p.where("len > 25")).select("source_no", "page_id")


@query("select page_id, cast(floor((row_number() over (order by page_id) - 1) / 50) as bigint) as chunk from v_page")
def chunk_pages(spark, sf):
    return Catalog(spark, sf)["page"].select("page_id").transform(pageset.chunked(50, "page_id"))


@query("select p.page_id, p.title, c.text from v_page p join v_content c on c.page_id = p.page_id where p.ns = 1")
def with_content(spark, sf):
    c = Catalog(spark, sf)
    return c["page"].where("ns = 1").join(c["content"].select("page_id", "text"), "page_id").select("page_id", "title", "text")


@query("select p.page_id, c.page_id as content_id from v_page p join v_content c on c.ns = p.ns and c.title = p.title where p.ns = 2")
def with_content_by_title(spark, sf):
    c = Catalog(spark, sf)
    own = c["content"].withColumnRenamed("page_id", "content_id")
    return c["page"].where("ns = 2").select(*PAGE).transform(pageset.with_content(own)).select("page_id", "content_id")


@query("select page_id from v_content where regexp_matches(text, 'Brand#1[0-9] and E')")
def text_matching(spark, sf):
    return Catalog(spark, sf)["content"].transform(pageset.text_matching("Brand#1[0-9] and E")).select("page_id")


@query("select page_id from v_page where is_redirect")
def redirects_only(spark, sf):
    return Catalog(spark, sf)["page"].transform(pageset.redirects(True)).select("page_id")


@query("select page_id, title from v_page order by title, page_id limit 25")
def limit_pages(spark, sf):
    return Catalog(spark, sf)["page"].select("page_id", "title").transform(pageset.limited_to(25, "title", "page_id"))


@query("""select distinct ns, title from (select p.ns, p.title from v_categorylinks c join v_page p on p.page_id = c.page_id where category = 'NATION_3' and type = 'page'
    union all select ns, title from v_page where ns = 0 and starts_with(title, 'small'))""")
def source_specs(spark, sf):
    from pagelode.sources.specs import parse_all

    return parse_all(spark, Catalog(spark, sf), ["cat:NATION_3", "prefix:small"]).select("ns", "title")


@query(f"""select distinct ns, title from (select p.ns, p.title from v_categorylinks c join v_page p on p.page_id = c.page_id where category = 'NATION_3' and type = 'subcat'
    union all select p.ns, p.title from v_categorylinks c join v_page p on p.page_id = c.page_id where category = 'NATION_4' and type = 'file' union all select ns, title from v_page where page_id in (select page_id from v_revision where "user" = 'user')
    union all select ns, title from v_page where not is_redirect and page_id not in (select page_id from v_categorylinks) union all select ns, title from v_content where {_holds('text', 'red', 'economy')})""")
def source_spec_kinds(spark, sf):
    """Page sets of five more kinds of specs, each page once."""
    from pagelode.sources.specs import parse_all

    return parse_all(spark, Catalog(spark, sf), ["subcats:NATION_3", "catfiles:NATION_4", "usercontribs:user", "special:Uncategorizedpages", "search:red economy"]).select("ns", "title")


# --- listing queries --------------------------------------------------------------------------


@query("select p.page_id, sortkey from v_categorylinks c join v_page p on p.page_id = c.page_id where category = 'NATION_4' and type = 'page' and sortkey >= 'Customer#000000010'", also="category_members_whole")
def category_members(spark, sf):
    return listing.category_members(Catalog(spark, sf), "NATION_4", "page", start_sort_key="Customer#000000010").select("page_id", "sortkey")


@query("select p.page_id, ts from v_categorylinks c join v_page p on p.page_id = c.page_id where category = 'NATION_5' and type = 'file'", also="category_members_by_time_whole")
def category_members_by_time(spark, sf):
    return listing.category_members(Catalog(spark, sf), "NATION_5", "file", sort="timestamp").select("page_id", "ts")


@query("select page_id, title from v_page where page_id in (select src_id from v_links where dst_id = 14 union select src_id from v_links where dst_id in (select src_id from v_redirect where dst_id = 14))")
def backlinks(spark, sf):
    return listing.backlinks(Catalog(spark, sf), 14).select("page_id", "title")


@query("select page_id, title from v_page where page_id in (select src_id from v_templatelinks where dst_id = 21)")
def transclusions(spark, sf):
    return listing.transclusions(Catalog(spark, sf), 21).select("page_id", "title")


@query("select page_id, title from v_page where page_id in (select dst_id from v_links where src_id = 3) and ns in (0, 1)")
def links_from(spark, sf):
    return listing.links_from(Catalog(spark, sf), 3, namespaces=[0, 1]).select("page_id", "title")


@query("select page_id from v_page where page_id in (select dst_id from v_templatelinks where src_id = 3)")
def templates_on(spark, sf):
    return listing.links_from(Catalog(spark, sf), 3, "templatelinks").select("page_id")


@query("select distinct category from v_categorylinks where page_id = 5")
def categories_of(spark, sf):
    return listing.categories_of(Catalog(spark, sf), 5)


@query("select page_id, lang, title from v_langlinks where page_id = 18 and trim(lang) <> '' union all select page_id, lang, title from v_langlinks where page_id = 20 and trim(lang) <> ''")
def language_links(spark, sf):
    c = Catalog(spark, sf)
    return listing.outside_links_on(c, 18, "langlinks").unionByName(listing.outside_links_on(c, 20, "langlinks"))


@query("select page_id, url from v_externallinks where page_id = 7")
def external_links_on(spark, sf):
    return listing.outside_links_on(Catalog(spark, sf), 7, "externallinks")


@query("select page_id, title from v_page where ns = 1 and title >= 'blue' and title <= 'red/widget 5' and not is_redirect", also="all_pages_whole")
def all_pages(spark, sf):
    return listing.all_pages(Catalog(spark, sf), 1, start="red/widget 5", end="blue", descending=True, redirects="no").select("page_id", "title")


@query("select category, count(*) as size from v_categorylinks where category >= 'NATION_1' and category <= 'NATION_7' group by category having count(*) between 2 and 1000")
def all_categories(spark, sf):
    return listing.all_categories(Catalog(spark, sf), "NATION_1", "NATION_7", least=2, most=1000)


@query("select distinct ns, title from v_links join v_page on page_id = dst_id where starts_with(title, 'red')")
def all_link_targets(spark, sf):
    return listing.all_targets(Catalog(spark, sf), prefix="red")


@query("select ns, title from v_redirect join v_page on page_id = dst_id where title >= 'green'")
def all_redirect_targets(spark, sf):
    return listing.all_targets(Catalog(spark, sf), "redirect", unique=False, start="green")


@query("select distinct ns, title from v_templatelinks join v_page on page_id = dst_id", also="all_transclusion_targets_whole")
def all_transclusion_targets(spark, sf):
    return listing.all_targets(Catalog(spark, sf), "templatelinks")


@query("select page_id, title from v_page where (starts_with(title, 'blue/b') or starts_with(title, 'Blue/b')) and ns in (0, 3)")
def prefix_search(spark, sf):
    return listing.prefix_search(Catalog(spark, sf), "blue/b", [0, 3]).select("page_id", "title")


_INDEXES: dict[tuple, search.Index] = {}


def _index(spark, sf, view: str) -> search.Index:
    """The index of a view's pages, built once a session; building writes tables when the query is planned."""
    key = spark.sparkContext.applicationId, sf, view
    if key not in _INDEXES:
        _INDEXES[key] = search.build(search.of_pages(Catalog(spark, sf)[view]), _scratch(spark))
    return _INDEXES[key]


@query(f"select page_id from v_content where {_holds('text', 'red', 'economy')}")
def search_text(spark, sf):
    return search.search(_index(spark, sf, "content"), Catalog(spark, sf)["content"], "Red economy", sort="none").select("page_id")


@query(f"select page_id from v_content where {_holds('text', 'red', 'economy')}")
def search_text_whole(spark, sf):
    """The same by a scan."""
    return listing.search(Catalog(spark, sf), "Red economy", sort="none").select("page_id")


@query()
def search_relevance(spark, sf):
    """The top of the ranking by tf * idf; a wiki's own ranking isn't defined outside it."""
    return search.search(_index(spark, sf, "content"), Catalog(spark, sf)["content"], "widget standard", limit=20).select("page_id", "score")


@query("""with w as (select page_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: x <> '') as words from v_content),
    n as (select count(*) + 1.0 as n, greatest(1, count(*) filter (where list_contains(words, 'widget'))) as a, greatest(1, count(*) filter (where list_contains(words, 'standard'))) as b from w)
    select page_id, round(cast(len(list_filter(words, lambda x: x = 'widget')) as double) / len(words) * ln(n / a) + cast(len(list_filter(words, lambda x: x = 'standard')) as double) / len(words) * ln(n / b), 6) as score
    from w, n where list_contains(words, 'widget') and list_contains(words, 'standard')""")
def search_relevance_whole(spark, sf):
    return search.search(_index(spark, sf, "content"), Catalog(spark, sf)["content"], "widget standard").select("page_id", F.round("score", 6).alias("score"))


@query(f"select page_id, title from v_content where {_holds('title', 'red', 'widget')}")
def search_title(spark, sf):
    return search.search(_index(spark, sf, "content"), Catalog(spark, sf)["content"], "Red widget", scope="title", sort="none").select("page_id", "title")


@query("select page_id, title from v_article where lower(title) = 'café noir 7'")
def search_near_match(spark, sf):
    return search.search(_index(spark, sf, "article"), Catalog(spark, sf)["article"], "CAFÉ NOIR 7", scope="near_match").select("page_id", "title")


@query(f"select page_id, ts from v_article where {_holds('text', 'für')} order by ts desc, page_id limit 25")
def search_last_edited(spark, sf):
    """The 25 hits that were edited last."""
    return search.search(_index(spark, sf, "article"), Catalog(spark, sf)["article"], "für", sort="last_edit_desc", limit=25).select("page_id", "ts")


@query(f"select page_id, created from v_article where {_holds('text', 'noir', 'café')} and ns in (1, 2) order by created, page_id limit 25")
def search_first_created(spark, sf):
    """The 25 oldest hits in two namespaces."""
    return search.search(_index(spark, sf, "article"), Catalog(spark, sf)["article"], "noir CAFÉ", namespaces=[1, 2], sort="create_asc", limit=25).select("page_id", "created")


@query(f"select page_id, title from v_article where {_holds('text', 'москва', 'дом')}")
def search_cyrillic(spark, sf):
    return search.search(_index(spark, sf, "article"), Catalog(spark, sf)["article"], "МОСКВА, дом!", sort="title").select("page_id", "title")


@query(f"select page_id, title from v_article where {_holds('title', 'café', 'noir')}")
def search_accents_by_scan(spark, sf):
    return listing.search({"content": Catalog(spark, sf)["article"]}, "café NOIR", scope="title", sort="none").select("page_id", "title")


@query("select page_id from v_article where regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])un[^\\p{L}\\p{M}\\p{N}_]+café[^\\p{L}\\p{M}\\p{N}_]+noir($|[^\\p{L}\\p{M}\\p{N}_])')")
def search_phrase(spark, sf):
    """Words that follow each other, by their positions."""
    return search.search(_index(spark, sf, "article"), Catalog(spark, sf)["article"], "un café noir", phrase=True).select("page_id")


@query("""select ns, w as token, count(distinct page_id) as docs, count(*) as occurrences from (select page_id, ns, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+')) as w from v_article) where w <> '' group by ns, w""")
def search_counts(spark, sf):
    """The counts beside the postings, of all words."""
    return _index(spark, sf, "article").counts.where("field = 'text'").select("ns", "token", "docs", "occurrences")


@query("""select a.event_id, r.rev_id, md5(r.text) as digest from (select event_id, event_id % 60 as page_id, cast(event_id % 7 as int) - 1 as at from events) a asof left join v_revision r on a.page_id = r.page_id and a.at >= r.ts""")
def content_as_of(spark, sf):
    """The text that a page had at a time, for a page and a time of each event."""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 60).alias("page_id"), ((F.col("event_id") % 7).cast("int") - 1).alias("at"))
    found = activity.content_at(Catalog(spark, sf)["revision"].select("page_id", "ts", "rev_id", "text"), e, width=2)
    return found.select("event_id", "rev_id", F.md5("text").alias("digest"))


@query("select page_id, title from v_page where not is_redirect and page_id not in (select src_id from v_links)")
def dead_end_pages(spark, sf):
    return listing.special_page(Catalog(spark, sf), "Deadendpages").select("page_id", "title")


@query("select page_id, title from v_page where not is_redirect and page_id not in (select page_id from v_categorylinks)")
def uncategorized_pages(spark, sf):
    return listing.special_page(Catalog(spark, sf), "Uncategorizedpages").select("page_id", "title")


@query("select page_id, len from v_page where not is_redirect order by len, page_id limit 25")
def shortest_pages(spark, sf):
    return listing.special_page(Catalog(spark, sf), "Shortpages", 25).select("page_id", "len")


@query("select page_id, len from v_page where not is_redirect order by len desc, page_id limit 25")
def longest_pages(spark, sf):
    return listing.special_page(Catalog(spark, sf), "Longpages", 25).select("page_id", "len")


@query("select page_id, title from v_page where not is_redirect and page_id not in (select dst_id from v_links)")
def lonely_pages(spark, sf):
    return listing.special_page(Catalog(spark, sf), "Lonelypages").select("page_id", "title")


@query("select category, count(*) as size from v_categorylinks where category not in (select title from v_page where ns = 14) group by category order by size desc, category limit 10")
def wanted_categories(spark, sf):
    return listing.special_page(Catalog(spark, sf), "Wantedcategories", 10)


@query("select p.page_id, n as size from (select dst_id, count(*) as n from v_links group by dst_id) join v_page p on p.page_id = dst_id order by n desc, p.page_id limit 20")
def most_linked(spark, sf):
    return listing.special_page(Catalog(spark, sf), "Mostlinked", 20).select("page_id", "size")


@query("select page_id, url from v_externallinks where regexp_extract(url, '^(https?)://', 1) = 'http' and regexp_extract(url, '^https?://([^/?#]+)', 1) = 'ththre.example.com'")
def external_link_usage(spark, sf):
    return listing.external_link_usage(Catalog(spark, sf), "ththre.example.com", "http")


@query()
def random_pages(spark, sf):
    return listing.random_pages(Catalog(spark, sf), 20, [0], seed=7).select(*PAGE)


@query("select page_id, title from v_page where page_id in (select page_id from v_watchlist where user = '1-URGENT') and ns in (2)")
def watchlist(spark, sf):
    return listing.watchlist(Catalog(spark, sf), "1-URGENT", [2]).select("page_id", "title")


@query("select page_id from v_page where page_id in (select page_id from v_page_props where property = 'good')")
def pages_with_property(spark, sf):
    return listing.pages_with_property(Catalog(spark, sf), "good").select("page_id")


@query("select ns, title, level from v_protected_titles where ns in (1, 3) and level = 'ECONOMY'")
def protected_titles(spark, sf):
    return listing.protected_titles(Catalog(spark, sf), [1, 3], "ECONOMY")


@query("""select p.page_id, count(distinct src_id) as n_sources, coalesce(min(src_id), -1) as first_source from v_page p left join v_links on dst_id = p.page_id
    where p.is_redirect group by p.page_id""")
def backlinks_of_many(spark, sf):
    c = Catalog(spark, sf)
    out = listing.sources_of(c["page"].where("is_redirect").select("page_id"), c["links"])
    return out.select("page_id", F.size("sources").cast("long").alias("n_sources"), F.coalesce(F.get("sources", 0), F.lit(-1)).alias("first_source"))


@query("select page_id, count(distinct \"user\") as n_users, cast(sum(case when \"user\" is null then 1 else 0 end) as bigint) as n_anonymous, coalesce(string_agg(distinct \"user\", ',' order by \"user\"), '') as users from v_revision group by page_id")
def contributors(spark, sf):
    return listing.contributors(Catalog(spark, sf)["revision"]).select("page_id", "n_users", "n_anonymous", F.array_join("users", ",").alias("users"))


@query("select category, count(*) as size, cast(sum(case when type = 'page' then 1 else 0 end) as bigint) as pages, cast(sum(case when type = 'file' then 1 else 0 end) as bigint) as files, cast(sum(case when type = 'subcat' then 1 else 0 end) as bigint) as subcats from v_categorylinks group by category")
def category_info(spark, sf):
    return listing.category_info(Catalog(spark, sf))


@query("select p_partkey as page_id, p_partkey % 5 <> 3 and exists (select 1 from v_content c where c.page_id = p_partkey) as found from part")
def exists(spark, sf):
    have = Catalog(spark, sf)["content"].select(F.lit(0).alias("ns"), F.col("page_id").cast("string").alias("title"))
    asked = table(spark, sf, "part").select(F.lit(0).alias("ns"), F.col("p_partkey").cast("string").alias("title"), F.col("p_partkey").alias("page_id"))
    return listing.exists(asked, {"page": have}).select("page_id", "found")


@query("select distinct title from v_page where page_id = 21 or page_id in (select src_id from v_redirect where dst_id = 21)")
def template_names(spark, sf):
    return listing.template_names(Catalog(spark, sf), 21)


@query("select name, edits from v_user where name >= 'Customer#000000100' and grp in ('BUILDING', 'FURNITURE') and edits > 0", also="all_users_whole")
def all_users(spark, sf):
    c = Catalog(spark, sf)
    users = c["user"].withColumn("groups", F.array("grp"))
    return listing.all_users({"user": users}, "Customer#000000100", groups=["BUILDING", "FURNITURE"], with_edits_only=True).select("name", "edits")


@query("select block_id from v_block where user in ('F', 'P') and auto and not temporary", also="blocks_whole")
def blocks(spark, sf):
    return listing.blocks(Catalog(spark, sf), ["F", "P"], flags=listing.parse_flags("auto|!temporary")).select("block_id")


@query("select sha1, count(distinct title) as n from v_file group by sha1 having count(distinct title) > 1")
def duplicate_files(spark, sf):
    return listing.duplicates_of(Catalog(spark, sf)["file"]).select("sha1", F.size("files").cast("long").alias("n"))


@query("select title, file_id, sha1 from (select *, row_number() over (partition by title order by ts desc, file_id desc) as rn from v_file) where rn = 1")
def latest_file(spark, sf):
    return listing.latest_file(Catalog(spark, sf)["file"]).select("title", "file_id", "sha1")


@query("""select page_id from v_geo where 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 40) / 2), 2) + cos(radians(40)) * cos(radians(lat)) * pow(sin(radians(lon - 179) / 2), 2)))) <= 2000000""")
def nearby(spark, sf):
    return listing.nearby(Catalog(spark, sf)["geo"], 40.0, 179.0, 2_000_000.0).select("page_id")


@query("select count(*) as pages, cast(sum(case when reviewed then 1 else 0 end) as bigint) as reviewed, cast(sum(case when reviewed then 0 else 1 end) as bigint) as unreviewed, min(case when not reviewed then ts end) as oldest from v_triage")
def new_page_stats(spark, sf):
    return listing.new_page_stats(Catalog(spark, sf)["triage"])


@query("select count(*) as pages, count(distinct ns) as namespaces, cast(sum(len) as bigint) as total_len, cast(sum(case when is_redirect then 1 else 0 end) as bigint) as redirects from v_page")
def statistics(spark, sf):
    return Catalog(spark, sf)["page"].agg(F.count("*").alias("pages"), F.countDistinct("ns").alias("namespaces"), F.sum("len").alias("total_len"), F.sum(F.col("is_redirect").cast("long")).alias("redirects"))


# --- histories, changes, logs -----------------------------------------------------------------


@query("select rev_id, size from v_revision where page_id = 3 and ts between 1 and 5 and (\"user\" is null or \"user\" <> 'assistant') order by ts desc, rev_id desc limit 10")
def history(spark, sf):
    return activity.history(Catalog(spark, sf)["revision"], 3, start=1, end=5, exclude_user="assistant", limit=10).select("rev_id", "size")


@query("select rev_id, page_id from v_revision where \"user\" = 'user'", also="all_revisions_whole")
def all_revisions(spark, sf):
    return activity.history(Catalog(spark, sf)["revision"], order="oldest", user="user").select("rev_id", "page_id")


@query("select rev_id, size from v_revision where rev_id in (select o_custkey * 100 from orders)")
def revisions_by_id(spark, sf):
    ids = table(spark, sf, "orders").select((F.col("o_custkey") * 100).alias("rev_id"))
    return activity.by_id(Catalog(spark, sf)["revision"], ids).select("rev_id", "size")


@query("select rev_id, lag(rev_id) over w as parent_id, size - coalesce(lag(size) over w, 0) as size_change from v_revision window w as (partition by page_id order by rev_id)")
def size_changes(spark, sf):
    return listing.with_size_change(Catalog(spark, sf)["revision"]).select("rev_id", "parent_id", "size_change")


@query("""with r as (select rev_id, page_id, text, lag(text) over (partition by page_id order by rev_id) as before, lag(rev_id) over (partition by page_id order by rev_id) as parent_id from v_revision),
    x as (select rev_id, parent_id, unnest(string_split(text, chr(10))) as line, 1 as sign from r where parent_id is not null
          union all select rev_id, parent_id, unnest(string_split(before, chr(10))), -1 from r where parent_id is not null),
    n as (select rev_id, parent_id, line, sum(sign) as n from x group by 1, 2, 3)
    select rev_id, parent_id, cast(sum(greatest(n, 0)) as bigint) as added, cast(sum(greatest(-n, 0)) as bigint) as removed from n group by 1, 2""")
def compare_revisions(spark, sf):
    return activity.compare(Catalog(spark, sf)["revision"]).select("rev_id", "parent_id", "added", "removed")


def _versions(spark, sf):
    return diffs.with_parent(Catalog(spark, sf)["version"], before="text").where("parent_id is not null").select("rev_id", "before", F.col("text").alias("after"))


@query("""with r as (select rev_id, text, lag(text) over (partition by page_id order by rev_id) as before from v_version)
    select rev_id, md5(text) as text_md5, cast(len(string_split(text, chr(10))) - len(string_split(before, chr(10))) as bigint) as line_change, text = before as same from r where before is not null""")
def hunks_applied(spark, sf):
    """The hunks of each document's second version applied to its first."""
    pairs = settled(_versions(spark, sf))
    out = diffs.applied(pairs, diffs.hunks(pairs))
    return out.select("rev_id", F.md5("text").alias("text_md5"), F.coalesce("line_change", F.lit(0)).alias("line_change"), F.col("line_change").isNull().alias("same"))


@query()
def revision_hunks(spark, sf):
    """Hunks of each revision against the one before; held against a plain version in the tests."""
    pairs = diffs.with_parent(Catalog(spark, sf)["revision"], before="text").where("parent_id is not null").select("rev_id", "before", F.col("text").alias("after"))
    found = diffs.hunks(pairs)
    return found.select("rev_id", "at", "to", F.size("removed").alias("n_removed"), F.size("added").alias("n_added"), F.md5(F.to_json(F.struct("removed", "added"))).alias("lines_md5"))


@query()
def unified_diffs(spark, sf):
    """Unified diffs of each document's two versions; held against a plain version in the tests."""
    pairs = _versions(spark, sf)
    return diffs.unified(pairs, diffs.hunks(pairs)).select("rev_id", F.md5("diff").alias("diff_md5"), F.length("diff").alias("n_chars"))


@query("select rc_id, page_id from (select *, row_number() over (partition by page_id order by ts desc, rc_id desc) as rn from v_recentchanges where type in ('click', 'view') and ns in (0, 2) and not bot) where rn = 1", also="recent_changes_whole")
def recent_changes(spark, sf):
    return activity.recent_changes(Catalog(spark, sf)["recentchanges"], [0, 2], ["click", "view"], flags={"bot": False, "minor": None}, top_only=True).select("rc_id", "page_id")


@query("select rc_id from (select *, row_number() over (partition by page_id order by ts desc, rc_id desc) as rn from v_recentchanges where page_id in (select page_id from v_watchlist where user = '5-LOW')) where rn = 1")
def watchlist_changes(spark, sf):
    c = Catalog(spark, sf)
    return activity.watchlist_changes(c["recentchanges"], c["watchlist"].where(F.col("user") == "5-LOW")).select("rc_id")


@query("select rev_id, rev_id = max(rev_id) over (partition by page_id) as is_top from v_revision qualify \"user\" = 'assistant'")
def contributions(spark, sf):
    return activity.contributions(Catalog(spark, sf)["revision"], "assistant").select("rev_id", "is_top")


@query("select log_id, ts from v_log where type = 'signup' and action = 'big' and ts >= '2024-01-05' and ts <= '2024-01-20'", also="log_events_whole")
def log_events(spark, sf):
    rows = Catalog(spark, sf)["log"]
    return activity.log_events(rows, "signup", "big", start="2024-01-05", end="2024-01-20").select("log_id", "ts")


@query("select event_id as log_id, case event_type when 'click' then 'move' when 'view' then 'rights' else 'unknown' end as details, nullif(event_id % 4, 0) as rev_id, cast(case when event_type = 'view' then 1 else 0 end as bigint) as n_added, case when event_type = 'click' then 'T' end as target from events where event_id % 6 <> 0")
def decode_log(spark, sf):
    kind = F.when(F.col("event_type") == "click", "move").when(F.col("event_type") == "view", "rights").otherwise("merge")
    json = F.format_string(
        '{"logid":%d,"type":"%s","ns":"odd","title":%s,"revid":%d,"timestamp":"2024-01-01T00:00:00Z","params":{"target_title":%s,"oldgroups":["a"],"newgroups":["a","b"]}}',
        "event_id", kind, F.when(F.col("event_id") % 6 == 0, "null").otherwise('"X"'), F.col("event_id") % 4, F.when(F.col("event_type") == "click", '"T"').otherwise("null"),
    )
    out = activity.decode_log(table(spark, sf, "events").select(json.alias("json")))
    added = F.when(F.col("details") == "rights", F.size("groups_added")).otherwise(0).cast("long")
    return out.select("log_id", "details", "rev_id", added.alias("n_added"), "target")


# --- series -----------------------------------------------------------------------------------


def _views(spark, sf):
    return Catalog(spark, sf)["views"].withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select title, date_trunc('day', ts) as ts, cast(sum(views) as bigint) as views from v_views where title = '7' and ts between '2024-01-03' and '2024-01-20' and agent = 'user' group by all")
def pageviews_per_article(spark, sf):
    return _plain(timeseries.per_article(_views(spark, sf), "en.wikipedia", "7", "2024-01-03", "2024-01-20", agent="user"))


@query("select date_trunc('hour', ts) as ts, cast(sum(views) as bigint) as views from v_views where ts between '2024-01-03' and '2024-01-09' and access = 'desktop' group by all")
def pageviews_aggregate(spark, sf):
    return _plain(timeseries.aggregate(_views(spark, sf), "en.wikipedia", "2024-01-03", "2024-01-09", "hourly", access="desktop"))


@query("select title, views, rank() over (order by views desc) as rank from (select title, cast(sum(views) as bigint) as views from v_views where date_trunc('month', ts) = '2024-01-01' and agent = 'user' group by title order by views desc, title limit 30)")
def pageviews_top(spark, sf):
    out = timeseries.top(_views(spark, sf), "en.wikipedia", "2024-01-11", 30, "monthly")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("select cast(c_custkey as string) as title, count(distinct date_trunc('day', ts)) as days, cast(coalesce(sum(views), 0) as bigint) as views from customer left join v_views on title = cast(c_custkey as string) and ts between '2024-01-01' and '2024-01-15' group by 1")
def pageviews_for_pages(spark, sf):
    pages = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("title"))
    out = timeseries.for_pages(pages, _views(spark, sf), "2024-01-01", "2024-01-15")
    return out.select("title", F.size("series").cast("long").alias("days"), F.aggregate("series", F.lit(0).cast("long"), lambda a, x: a + x["views"]).alias("views"))


@query("select cast(user_id as string) as title, date_trunc('hour', ts) as ts, case when event_id % 4 = 0 then 0 else event_id end as views from events where event_id % 5 <> 0")
def decode_pageviews(spark, sf):
    e = table(spark, sf, "events")
    hour = F.when(F.col("event_id") % 5 == 0, "20249999").otherwise(F.date_format("ts", "yyyyMMddHH"))
    views = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.format_string(',"views":%d', "event_id"))
    json = F.format_string('{"project":"p","article":"%d","timestamp":"%s","access":"desktop","agent":"user"%s}', "user_id", hour, views)
    return _plain(timeseries.decode(e.select(json.alias("json"))).select("title", "ts", "views"))


# --- scalars ----------------------------------------------------------------------------------


@query("""select event_id, case event_id % 3 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) end as ts, event_id % 4 = 1 as never from events""")
def parse_timestamps(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), scalars.format_compact(F.col("at")))).when(F.col("event_id") % 3 == 1, scalars.format_timestamp(F.col("at"))).otherwise("31 Feb")
    never = scalars.parse_expiry(F.when(F.col("event_id") % 4 == 1, F.lit(" Infinity ")).otherwise(F.lit("soon")))["never"]
    return e.select("event_id", scalars.parse_timestamp(text).cast("timestamp_ntz").alias("ts"), never.alias("never"))


@query("""with d as (select p_partkey as k, lpad(cast(p_partkey * 7919 % 1000000000 as string), 9, '0') as s, p_partkey % 11 as c from part),
    t as (select k, s, c, (select sum((10 - i) * cast(s[i + 1] as int)) from range(0, 9) r(i)) % 11 as r, (select sum((case when i % 2 = 0 then 1 else 3 end) * cast(('978' || s)[i + 1] as int)) from range(0, 12) r(i)) % 10 as q from d)
    select k as page_id, (11 - r) % 11 = c as valid, case when (11 - r) % 11 = c then '978' || s || cast((10 - q) % 10 as string) end as isbn13 from t""")
def isbns(spark, sf):
    stem = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    check = F.when(F.col("p_partkey") % 11 == 10, "x").otherwise((F.col("p_partkey") % 11).cast("string"))
    isbn = F.concat(F.substring(stem, 1, 1), F.lit("-"), F.substring(stem, 2, 8), F.lit(" "), check)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), scalars.isbn_valid(isbn).alias("valid"), scalars.to_isbn13(isbn).alias("isbn13"))


@query("select p_partkey as page_id, case when p_partkey % 3 = 0 then p_name end as target from part")
def redirect_targets(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\n #REDIRECT : [["), F.col("p_name"), F.lit("#part|x]]"))).otherwise(F.concat(F.lit("see [["), F.col("p_name"), F.lit("]]")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), scalars.redirect_target(text).alias("target"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'l' || cast(n_nationkey as string) || '.wikipedia' end as project from nation")
def projects(spark, sf):
    k = F.col("n_nationkey").cast("string")
    server = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://l"), k, F.lit(".m.wikipedia.org:443/wiki"))).otherwise(F.concat(F.lit("//www."), k, F.lit(".example.org")))
    return table(spark, sf, "nation").select("n_nationkey", scalars.project_of(server).alias("project"))


@query("select p_partkey as page_id, replace(replace(p_name || '&' || p_brand, ' ', '_'), '&', '%26') as seg from (select p_partkey, p_name, replace(p_brand, '#', '%23') as p_brand from part)")
def article_segments(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), scalars.article_segment(F.concat("p_name", F.lit("&"), "p_brand")).alias("seg"))


@query("select p_partkey as page_id, case when p_size % 2 = 0 then 'File:' || p_name else p_name end as title, cast(case when p_size % 4 < 2 then 0 else 2 end as int) as subject, cast(p_size % 4 - (p_size % 4) % 2 + 1 as int) as talk from part")
def refs(spark, sf):
    ns = (F.col("p_size") % 4).cast("int")
    full = F.concat(F.lit("File:"), "p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), scalars.ref_of(full, F.col("p_size") % 2).alias("title"), scalars.subject_ns(ns).alias("subject"), scalars.talk_ns(ns).alias("talk"))


@query("""select p_partkey as page_id, cast(case when p_size % 10 = 1 and p_size % 100 <> 11 then 0 when p_size % 10 between 2 and 4 and not p_size % 100 between 12 and 14 then 1 else 2 end as int) as ru, cast(case when p_size <= 1 then 0 else 2 end as int) as fr,
    cast(case when p_size = 1 then 0 when p_size between 2 and 4 then 1 else 3 end as int) as cs, cast(case when p_size = 0 then 0 when p_size = 1 then 1 when p_size = 2 then 2 when p_size % 100 between 3 and 10 then 3 when p_size % 100 between 11 and 99 then 4 else 5 end as int) as ar,
    cast(case when p_size % 10 = 1 and p_size % 100 <> 11 then 0 when p_size % 10 between 2 and 9 and not p_size % 100 between 11 and 19 then 1 else 3 end as int) as lt, cast(0 as int) as ja, cast(null as int) as qqx from part""")
def plurals(spark, sf):
    from pagelode.functions import plurals

    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), *[plurals.index(F.col("p_size"), x).alias(x) for x in ("ru", "fr", "cs", "ar", "lt", "ja", "qqx")])


@query("""select p_partkey as page_id, case p_partkey % 4 when 0 then 'de' when 1 then 'no' when 2 then 'en' end as tried, case p_partkey % 4
    when 0 then cast(p_size as string) || case when p_size = 1 then ' Seite' else ' Seiten' end || ' von ' || p_brand when 1 then p_brand || ' har ' || cast(p_size as string) || case when p_size = 1 then ' side' else ' sider' end
    when 2 then p_brand || ': ' || case when p_size = 1 then '[[page|a page]]' else cast(p_size as string) || ' {{pages|x}}' end || ' and ' || case when p_size = 1 then 'it' else 'they' end end as text from part""")
def messages(spark, sf):
    """A message in a language that has it, one of its fallbacks, or English, with several plurals and arguments."""
    from pagelode.operators import messages

    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    bundles = p.select(F.explode(F.array(*[F.struct(F.lit(a).alias("language"), F.lit(b).alias("key"), F.lit(c).alias("text")) for a, b, c in (
        ("de", "found", "$1 {{PLURAL:$1|Seite|Seiten}} von $2"), ("no", "found", "$2 har $1 {{plural: $1 |side|sider}}"), ("en", "found", "$2: {{PLURAL:$1|[[page|a page]]|$1 {{pages|x}}}} and {{PLURAL:$1|it|they}}"), ("en", "other", "x"),
    )])).alias("b")).select("b.*").distinct()
    edges = p.select(F.explode(F.array(*[F.struct(F.lit(a).alias("language"), F.lit(b).alias("fallback"), F.lit(c).alias("rank")) for a, b, c in (("nn", "nb", 0), ("nn", "no", 1), ("nb", "no", 0))])).alias("e")).select("e.*").distinct()
    asked = p.select(F.col("p_partkey").alias("page_id"), F.when(k == 3, "none").otherwise("found").alias("key"), F.when(k == 0, "de").when(k == 1, "nn").otherwise("ru").alias("language"), F.array(F.col("p_size").cast("string"), F.col("p_brand")).alias("arguments"))
    found = messages.texts(asked, bundles, edges)
    return found.select("page_id", "tried", messages.expanded(F.col("template"), F.col("tried"), F.col("arguments")).alias("text"))


@query("select event_id, date_trunc('minute', ts) as ts, case event_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end as language from events")
def signatures(spark, sf):
    month = lambda lang: F.get(F.array(*[F.lit(m.split("|")[-1]) for m in dates.MONTHS[lang]]), F.month("ts") - 1)
    part = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 4
    signed = (
        F.when(k == 0, F.concat(part("HH:mm, d "), month("en"), part(" yyyy"), F.lit(" (UTC)"))).when(k == 1, F.concat(part("d "), month("fr"), part(" yyyy"), F.lit(" à "), part("HH:mm"), F.lit(" (UTC)")))
        .when(k == 2, F.concat(part("HH:mm, d. "), month("de"), part(" yyyy"), F.lit(" (UTC)"))).otherwise(F.concat(part("HH:mm d "), month("es"), part(" yyyy"), F.lit(" (UTC)")))
    )
    text = F.concat(F.lit("Text <!-- 10:00, 1 May 2020 (UTC) --> 12:00, 31 February 2020 (UTC) "), signed, F.lit(" end"))
    out = table(spark, sf, "events").select("event_id", text.alias("text")).transform(dates.exploded)
    # the Spanish format has an English month's neighbour only in other texts, so one time each
    return out.select("event_id", F.col("signature.ts").cast("timestamp_ntz").alias("ts"), F.col("signature.language").alias("language"))


@query("""with c as (select length('<!-- 10:00, 1 May 2020 (UTC) -->') + 3 as n) select event_id, cast(unnest(case when event_id % 2 = 0 then [n, n + 28] else [2, 31] end) as int) as start, unnest(case when event_id % 2 = 0 then ['fr', 'en'] else ['en', 'fr'] end) as language,
    make_timestamp(2024, 5, day(ts), hour(ts), minute(ts), 0) as ts from events, c""")
def signature_offsets(spark, sf):
    """Where signature times stand, in order of place and not of format; a comment before them counts by its length."""
    part = lambda f: F.date_format("ts", f)
    en, fr = F.concat(part("HH:mm, dd"), F.lit(" May 2024 (UTC)")), F.concat(part("dd"), F.lit(" mai 2024 à "), part("HH:mm"), F.lit(" (UTC)"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<!-- 10:00, 1 May 2020 (UTC) --> é "), fr, F.lit(" | "), en)).otherwise(F.concat(F.lit("é "), en, F.lit(" and "), fr))
    own = table(spark, sf, "events").select("event_id", F.explode(dates.signatures(text, ["en", "fr"])).alias("s"))
    return own.select("event_id", "s.start", "s.language", F.col("s.ts").cast("timestamp_ntz").alias("ts"))


@query("""select event_id, 'en' as language from events where event_id % 3 = 0 union all select event_id, 'fr' from events where event_id % 3 <> 0""")
def latest_signatures(spark, sf):
    """The latest time of a text; of equal times the one that stands first, whatever its format."""
    day = F.when(F.col("event_id") % 3 == 1, "06").otherwise("05")
    en, fr = F.lit("10:00, 05 May 2024 (UTC)"), F.concat(day, F.lit(" mai 2024 à 10:00 (UTC)"))
    text = F.when(F.col("event_id") % 3 == 2, F.concat(fr, F.lit(" "), en)).otherwise(F.concat(en, F.lit(" "), fr))
    own = table(spark, sf, "events").select("event_id", dates.latest(dates.signatures(text, ["en", "fr"])).alias("s"))
    return own.select("event_id", "s.language")


@query("select p_partkey as page_id, case when p_size % 12 in (1, 3, 5, 8, 10) and p_partkey % 32 = 31 or p_size % 12 = 1 and p_partkey % 32 = 30 or p_partkey % 32 = 0 then null else cast(p_size % 12 + 1 as int) end as month, case when p_size % 12 in (1, 3, 5, 8, 10) and p_partkey % 32 = 31 or p_size % 12 = 1 and p_partkey % 32 = 30 or p_partkey % 32 = 0 then null else cast(p_partkey % 32 as int) end as day from part")
def day_titles(spark, sf):
    month, day = (F.col("p_size") % 12 + 1).cast("int"), (F.col("p_partkey") % 32).cast("int")
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), dates.day_title(month, day, "fr").alias("title"))
    return t.withColumn("d", dates.parse_day_title(F.col("title"), "fr")).select("page_id", "d.month", "d.day")


@query("select p_partkey as page_id, case p_partkey % 5 when 0 then 'local' when 1 then 'interwiki' when 2 then 'invalid' else 'local' end as kind, cast(case p_partkey % 5 when 0 then 10 when 3 then 0 when 4 then 15 end as int) as ns, case when p_partkey % 5 in (0, 3, 4) then upper(p_name[1]) || p_name[2:] end as text from part")
def parse_titles(spark, sf):
    k = F.col("p_partkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit(" :Template:_"), "p_name")).when(k == 1, F.concat(F.lit("fr:"), "p_name")).when(k == 2, F.concat("p_name", F.lit("[x]")))
        .when(k == 3, F.concat(F.lit("en:"), "p_name", F.lit("#frag"))).otherwise(F.concat(F.lit("category_TALK :"), F.replace("p_name", F.lit(" "), F.lit("__"))))
    )
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), titles.parse(raw, interwiki=frozenset({"fr"}), own=frozenset({"en"})).alias("t"))
    return t.select("page_id", "t.kind", "t.ns", "t.text")


# --- entities and result services -------------------------------------------------------------


def _entities(spark, sf):
    c = table(spark, sf, "customer")
    snak = lambda kind, value: F.concat(F.lit(f'{{"snaktype":"{kind}","property":"P1"'), value, F.lit("}"))
    amount = F.format_string(',"datavalue":{"type":"quantity","value":{"amount":"+%d","unit":"1"}}', "c_custkey")
    k = F.col("c_custkey") % 3
    first = F.when(k == 0, snak("novalue", F.lit(""))).when(k == 1, snak("somevalue", F.lit(""))).otherwise(snak("value", amount))
    rank = F.when(F.col("c_custkey") % 2 == 0, "normal").otherwise("deprecated")
    json = F.concat(
        F.format_string('{"type":"item","id":"Q%d","labels":{"%s":{"language":"x","value":"%s"}},"descriptions":{"mul":{"language":"mul","value":"d"}},"aliases":[],"claims":{"P1":[', "c_custkey", F.when(k == 0, "mul").otherwise("en"), "c_name"),
        F.lit('{"rank":"'), rank, F.lit('","mainsnak":'), first, F.lit('},{"rank":"'), F.when(k == 1, "preferred").otherwise("normal"), F.lit('","mainsnak":'), snak("value", amount),
        F.lit('}]},"sitelinks":{"enwiki":{"site":"enwiki","title":"'), "c_name", F.lit('"}}'), F.when(F.col("c_custkey") % 10 == 9, ',"missing":""').otherwise(""), F.lit("}"),
    )
    return entities.decode(c.select(json.alias("json")))


@query("select 'Q' || cast(c_custkey as string) as id, 'item' as kind, c_name as label, cast(null as string) as description from customer where c_custkey % 10 <> 9")
def decode_entities(spark, sf):
    return _entities(spark, sf).select("id", "kind", entities.label(F.col("labels"), "en").alias("label"), entities.description(F.col("descriptions"), "en").alias("description"))


@query("""select 'Q' || cast(c_custkey as string) as id, case when c_custkey % 3 = 1 then 'preferred' else 'normal' end as rank,
    case when c_custkey % 3 = 1 or c_custkey % 2 = 1 or c_custkey % 3 = 2 then 'value' else 'novalue' end as snaktype from customer where c_custkey % 10 <> 9""")
def best_statements(spark, sf):
    return _entities(spark, sf).select("id", entities.best(F.col("statements"), "P1").alias("b")).select("id", "b.rank", "b.mainsnak.snaktype")


@query("""select 'Q' || cast(c_custkey as string) as id, cast(pos as int) as pos, case when pos = 0 and c_custkey % 3 = 0 then 'novalue' when pos = 0 and c_custkey % 3 = 1 then 'somevalue' else 'value' end as snaktype,
    case when pos = 1 or c_custkey % 3 = 2 then '+' || cast(c_custkey as string) end as value from customer, range(0, 2) r(pos) where c_custkey % 10 <> 9""")
def entity_statements(spark, sf):
    return entities.exploded(_entities(spark, sf)).select("id", "pos", "snaktype", "value")


@query("""with e as (select c_custkey as k, c_custkey % 4 as f, 'Café ' || n_name as en_label, c_mktsegment || ' дом' as alias, n_name || ' maison' as mul_label from customer join nation on n_nationkey = c_nationkey)
    select 'Q' || cast(k as string) as id, case when f = 1 then mul_label when f <> 3 then en_label end as label, case when f = 2 then 'in English' end as description,
    case when f = 1 then 'mul' else 'en' end as language, f = 3 as is_alias from e
    where case f when 0 then list_contains(regexp_split_to_array(lower(en_label), '[^\\p{L}\\p{M}\\p{N}_]+'), 'france') when 1 then list_contains(regexp_split_to_array(lower(mul_label), '[^\\p{L}\\p{M}\\p{N}_]+'), 'france')
    when 2 then list_contains(regexp_split_to_array(lower(en_label), '[^\\p{L}\\p{M}\\p{N}_]+'), 'france') else alias = 'FRANCE' end""")
def entity_search(spark, sf):
    """Labels and aliases of customers' entities in English, falling back to the labels for all languages."""
    return search.search_entities(*_named_entities(spark, sf), "France").select("id", "label", "description", "language", "is_alias")


@query("select 'Q' || cast(c_custkey as string) as id, cast(null as string) as label, 'en' as language, true as is_alias from customer where c_custkey % 4 = 3 and c_mktsegment = 'BUILDING'")
def entity_search_alias(spark, sf):
    return search.search_entities(*_named_entities(spark, sf), "ДОМ building").select("id", "label", "language", "is_alias")


def _named_entities(spark, sf):
    """(index, entities): a fourth have an English label, a fourth one for all languages, a fourth a description too, a fourth only aliases."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey") % 4
    en = F.concat(F.lit('"en":{"language":"en","value":"Café '), "n_name", F.lit('"}'))
    of_all = F.concat(F.lit('"mul":{"language":"mul","value":"'), "n_name", F.lit(' maison"}'))
    alias = F.concat(F.lit('"en":[{"language":"en","value":"other"},{"language":"en","value":"'), "c_mktsegment", F.lit(' дом"}]'))
    json = F.concat(
        F.format_string('{"type":"item","id":"Q%d","labels":{', "c_custkey"), F.when(k == 1, of_all).when(k == 3, "").otherwise(en), F.lit('},"descriptions":{'),
        F.when(k == 2, '"en":{"language":"en","value":"in English"}').otherwise(""), F.lit('},"aliases":{'), F.when(k == 3, alias).otherwise(""), F.lit("}}"),
    )
    found = entities.decode(c.select(json.alias("json")))
    key = spark.sparkContext.applicationId, sf, "entities"
    if key not in _INDEXES:
        _INDEXES[key] = search.build(search.of_entities(found), _scratch(spark))
    return _INDEXES[key], found


@query("""select 'Q' || cast(c_custkey as string) as id, cast(pos as int) as pos, case when pos = 0 and c_custkey % 3 = 0 then 'novalue' when pos = 0 and c_custkey % 3 = 1 then 'somevalue' else 'value' end as snaktype,
    case when pos = 1 or c_custkey % 3 = 2 then '+' || cast(c_custkey as string) end as value, c_name as title from customer, range(0, 2) r(pos) where c_custkey % 10 <> 9""")
def written_entities(spark, sf):
    """Entities written as JSON with their claims and decoded from it, their statements taken apart and grouped again on the way."""
    own = _entities(spark, sf)
    grouped = entities.from_statement_rows(entities.statement_rows(own))
    again = entities.decode(entities.encode(own.drop("statements").join(grouped, "id")).drop("id"))
    titles_ = again.select("id", F.try_element_at("sitelinks", F.lit("enwiki")).alias("title"))
    return entities.exploded(again).select("id", "pos", "snaktype", "value").join(titles_, "id")


@query("select c_custkey as page_id, case when c_custkey % 10 <> 9 then 'Q' || cast(c_custkey as string) end as entity_id from customer")
def entities_of_pages(spark, sf):
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"))
    return entities.for_pages(pages, _entities(spark, sf), "enwiki").select("page_id", "entity_id")


@query("select 'Q' || cast(n_nationkey as string) as id from nation where n_nationkey % 2 = 0")
def sparql_entities(spark, sf):
    from pagelode.sources import results

    item = F.format_string('{"item":{"type":"uri","value":"http://x/entity/Q%d"}}', "n_nationkey")
    other = F.format_string('{"item":{"type":"literal","value":"/entity/Q%d"}}', "n_nationkey")
    json = F.concat(F.lit('{"results":{"bindings":['), F.when(F.col("n_nationkey") % 2 == 0, item).otherwise(other), F.lit("]}}"))
    return results.entity_ids(results.sparql_json(table(spark, sf, "nation").select(json.alias("json"))), "item")


@query("select n_nationkey, cast(n_nationkey as string) || chr(9) || 'x' || chr(92) || 'n' as value, 'de' as language from nation")
def sparql_terms(spark, sf):
    from pagelode.sources import results

    cell = F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('\\tx\\\\n"@de'))
    return table(spark, sf, "nation").select("n_nationkey", results.term(cell).alias("t")).select("n_nationkey", "t.value", "t.language")


# --- markup -----------------------------------------------------------------------------------


def _parts(spark, sf):
    p = table(spark, sf, "part")
    text = F.format_string("Intro {{part|%d|brand=old|{{small|x}}|brand=%s|size= %d }} and [[%s#top|%s]].\n== %s ==\nText [[:Category:%s]] <nowiki>{{no}}</nowiki>\n=== Sub ===\n", "p_partkey", "p_brand", "p_size", "p_name", "p_type", "p_type", "p_type")
    return p.select(F.col("p_partkey").alias("page_id"), text.alias("text"))


@query("select p_partkey as page_id, cast(p_partkey as string) as first, p_brand as brand, cast(p_size as string) as size from part")
def templates(spark, sf):
    own = wikitext.templates(wikitext.node_table(_parts(spark, sf), "page_id"), "part")
    arg = lambda k: F.try_element_at("args", F.lit(k))
    return own.select("page_id", arg("1").alias("first"), arg("brand").alias("brand"), arg("size").alias("size"))


@query("select p_partkey as page_id, 'Part' as key from part union all select p_partkey, 'Small' from part")
def templates_named(spark, sf):
    """Calls of any of several templates, nested ones included."""
    return wikitext.templates(wikitext.node_table(_parts(spark, sf), "page_id"), ["part", "Template:small", "none"]).select("page_id", "key")


@query("""select p_partkey as page_id, '#if' as function, cast(p_size as varchar) as argument from part union all select p_partkey, 'lc', p_brand from part
    union all select p_partkey, 'PAGENAME', null from part union all select p_partkey, 'uc', p_name from part""")
def parser_functions(spark, sf):
    """Calls of parser functions and variables; a variable's name with parameters is a template."""
    text = F.format_string("{{#if: %d |a|b}} {{lc:%s}} {{PAGENAME}} {{PAGENAME|x}} {{subst:uc: %s }} {{lc}} {{plain|y=1}}", "p_size", "p_brand", "p_name")
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), text.alias("text"))
    return wikitext.parser_functions(wikitext.node_table(pages, "page_id")).select("page_id", "function", "argument")


@query("""select p_partkey as page_id, case p_size % 6 when 0 then 'DEFAULTSORT' when 1 then 'NUMBEROFARTICLES' when 2 then 'ServerName' when 3 then 'LOCALMONTHNAME' when 4 then 'FullURL' else 'TALKPAGENAMEE' end as function,
    case p_size % 6 when 0 then p_name when 4 then p_brand when 5 then p_type end as argument from part""")
def magic_words(spark, sf):
    """Names whose case counts and names whose case doesn't; lower-case names of the first kind are templates."""
    call = _turn(F.concat(F.lit("{{DEFAULTSORT:"), "p_name", F.lit("}}{{defaultsort:x}}")), "{{NUMBEROFARTICLES}}{{numberofarticles}}", "{{ServerName}}{{SITEname}}", "{{ SafeSubst: LOCALMONTHNAME }}{{LOCALMONTHNAME|1}}", F.concat(F.lit("{{raw:MSG:FullURL："), "p_brand", F.lit("|x}}")), F.concat(F.lit("{{TALKPAGENAMEE: "), "p_type", F.lit(" }}{{raw: lc}}")))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), call.alias("text"))
    return wikitext.parser_functions(wikitext.node_table(pages, "page_id")).select("page_id", "function", "argument")


@query("select p_partkey as page_id, p_name as target, 'top' as fragment, p_type as label from part union all select p_partkey, ':Category:' || p_type, null, null from part")
def wikilinks(spark, sf):
    return wikitext.wikilinks(wikitext.node_table(_parts(spark, sf), "page_id")).select("page_id", "target", "fragment", "label")


@query("select p_type as category, count(*) as n from part group by p_type")
def category_links(spark, sf):
    return wikitext.categories(wikitext.node_table(_parts(spark, sf), "page_id")).groupBy("category").agg(F.count("*").alias("n"))


@query("select p_partkey as page_id, 1 as idx, 2 as level, p_type as title, cast(null as int) as parent from part union all select p_partkey, 2, 3, 'Sub', 1 from part")
def sections(spark, sf):
    return wikitext.sections(wikitext.node_table(_parts(spark, sf), "page_id"), "page_id").select("page_id", "idx", "level", "title", "parent")


@query("select count(*) as pages, count(*) as same from part")
def round_trips(spark, sf):
    own = _parts(spark, sf).withColumn("back", wikitext.serialized(wikitext.nodes(F.col("text"))))
    return own.agg(F.count("*").alias("pages"), F.sum((F.col("back") == F.col("text")).cast("long")).alias("same"))


@query("select p_partkey as page_id, 'Intro  and ' || p_type || '.' as visible from part")
def visible_text(spark, sf):
    own = _parts(spark, sf).select("page_id", wikitext.visible(F.col("text")).alias("v"))
    return own.select("page_id", F.substring_index("v", "\n", 1).alias("visible"))


@query("""select l_orderkey as page_id, l_linenumber as line, l_quantity as quantity, min(l_returnflag) over (partition by l_orderkey) as flag from
    (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as rn from lineitem) where rn = 1""", also="table_cells_whole")
def table_cells(spark, sf):
    """A table for each order, over all of lineitem."""
    return _table_cells(table(spark, sf, "lineitem"))


def _table_cells(items: DataFrame) -> DataFrame:
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).alias("x")
    own = items.groupBy("l_orderkey", "l_linenumber").agg(first)
    rows = own.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "x"))).alias("r"), F.min("x.l_returnflag").alias("flag"))
    line = lambda r, i: F.concat(F.lit("|-\n| "), r["l_linenumber"].cast("string"), F.lit(" || "), r["x"]["l_quantity"].cast("string"), F.when(i == 0, F.concat(F.lit(' || rowspan="0" | '), F.col("flag"))).otherwise(""), F.lit("\n"))
    text = F.concat(F.lit('{| class="wikitable"\n! line !! quantity !! flag\n'), F.array_join(F.transform("r", line), ""), F.lit("|}"))
    cells = wikitext.tables(rows.select(F.col("l_orderkey").alias("page_id"), text.alias("text")), "page_id").where("not header")
    out = cells.groupBy("page_id", "row").pivot("col", [0, 1, 2]).agg(F.first("text"))
    return out.select("page_id", F.col("0").cast("int").alias("line"), F.col("1").cast("double").alias("quantity"), F.col("2").alias("flag"))


@query("""select p_partkey as page_id, p_name || ' 1990–1995… ok {{x|1990-1995...}} ' || case p_size % 3 when 0 then p_brand || '… a' when 1 then '[[' || p_brand || '...|b c]]' else '<nowiki>a   b...</nowiki>' end as text from part""")
def fixes(spark, sf):
    """Fixes of prose by name; templates, link targets and raw tags stay."""
    pages, nodes = _varied(spark, sf, F.col("p_name"), "   1990-1995... ok {{x|1990-1995...}} ", _turn(F.concat("p_brand", F.lit("...   a")), F.concat(F.lit("[["), "p_brand", F.lit("...|b   c]]")), "<nowiki>a   b...</nowiki>"))
    return edits.applied(pages, nodes, edits.rewritten(nodes, edits.fixed("extra-spaces", "date-ranges", "ellipsis")))


@query("select p_partkey as page_id, p_name || chr(10) || chr(10) || chr(10) || '[[' || p_brand || ']] <pre>a  ' || chr(10) || chr(10) || chr(10) || chr(10) || '</pre>' as text from part")
def cosmetic_changes(spark, sf):
    text = F.concat("p_name", F.lit(" \t\n\n\n\n\n[["), "p_brand", F.lit("|"), "p_brand", F.lit("]] <pre>a  \n\n\n\n</pre>"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), wikitext.cosmetic(text).alias("text"))


@query("select p_partkey as page_id, 'see ' || p_type || ' and ' || case when p_name = 'red widget' then p_name else '[[' || p_name || ']]' end || ' or [[' || p_brand || ']]' as text from part", also="unlinks_whole")
def unlinks(spark, sf):
    """Links to a page taken off, by label or target; links elsewhere stay."""
    pages, nodes = _varied(spark, sf, "see [[Red_widget#x|", F.col("p_type"), "]] and [[", F.col("p_name"), "]] or [[", F.col("p_brand"), "]]")
    return edits.applied(pages, nodes, edits.unlink(nodes, "red widget"))


@query("select p_partkey as page_id, '{{box|a|size= 9 |x=1}} {{Box|size=9}} [[Category:' || p_type || ']]' as text from part")
def set_parameters(spark, sf):
    pages, nodes = _varied(spark, sf, "{{box|a|size= 3 |x=1}} {{Box}} [[category:old]]")
    own = edits.applied(pages, nodes, edits.set_parameter(nodes, ["Box"], "size", "9"))
    own = own.join(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), "p_type"), "page_id")
    return own.select("page_id", F.replace(wikitext.change_category(F.col("text"), "old", "NEW"), F.lit("category:NEW"), F.concat(F.lit("Category:"), F.col("p_type"))).alias("text"))


def _varied(spark, sf, *text) -> tuple[DataFrame, DataFrame]:
    """(pages, nodes): a page for each part, its text put together from columns, parsed once and written."""
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("text"))
    path = _scratch(spark)
    wikitext.whole_table(pages, "page_id").write.parquet(path)
    return pages, spark.read.parquet(path)


def _turn(*texts):
    """One of several texts, by the part's size."""
    k = F.col("p_size") % len(texts)
    out = F
    for i, t in enumerate(texts):
        out = out.when(k == i, F.lit(t) if isinstance(t, str) else t)
    return out


@query("""select p_partkey as page_id, 'a ' || case p_size % 4 when 0 then '[' || p_brand || ']' when 1 then '{{box|[' || p_brand || ']|n=' || p_name || '}}' when 2 then '[[' || p_name || '|[' || p_brand || '] {{small|y}}]]' else p_name end || ' z' as text from part""")
def node_replace(spark, sf):
    """A template replaced wherever it stands, in templates and links too, by another text on each page."""
    pages, nodes = _varied(spark, sf, "a ", _turn("{{small|x}}", F.concat(F.lit("{{box|{{small|x}}|n="), "p_name", F.lit("}}")), F.concat(F.lit("[["), "p_name", F.lit("|{{small|x}} {{small|y}}]]")), F.col("p_name")), " z")
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("["), "p_brand", F.lit("]")).alias("brand"))
    return edits.applied(pages, nodes, edits.of_nodes(nodes.join(brands, "page_id"), edits.like("{{small|x}}", "template"), F.col("brand")))


@query("""select p_partkey as page_id, case p_size % 4 when 0 then p_name || ' z' when 1 then ' ' || p_name || ' z' when 2 then '[[' || p_name || '|  ]] z' else ' z' end as text from part""")
def node_remove(spark, sf):
    """Templates and comments removed; one inside another goes with it."""
    pages, nodes = _varied(spark, sf, _turn(F.col("p_name"), F.concat(F.lit("{{box|{{small|x}}<!-- c -->}} "), "p_name"), F.concat(F.lit("[["), "p_name", F.lit("|{{small|x}} <!-- d --> {{a}}]]")), F.concat(F.lit("<!-- {{b}} "), "p_brand", F.lit(" -->"))), " z")
    return edits.applied(pages, nodes, edits.of_nodes(nodes, F.col("kind").isin("template", "comment"), None))


@query("""select p_partkey as page_id, case p_size % 4 when 0 then '{{ Box new |size= 9 |b=' || p_name || '}}' when 1 then '{{Box new|{{Box new|size=9}}|size=9}}' when 2 then '{{other|{{Box new|1|size=' || p_name || '|size=9}}}}' else p_name end as text from part""")
def map_templates(spark, sf):
    """Templates of a name, nested ones too, renamed, one parameter set and one dropped."""
    pages, nodes = _varied(spark, sf, _turn(F.concat(F.lit("{{ box |size= 3 |b="), "p_name", F.lit("|gone=1}}")), "{{Template:Box|{{box|gone={{x}}}}}}", F.concat(F.lit("{{other|{{Box|1|size="), "p_name", F.lit("|size=4|gone=}}}}")), F.col("p_name")))
    return edits.applied(pages, nodes, edits.map_templates(nodes, ["box"], rename="Box new", parameters={"size": "9", "gone": None}))


@query("""select p_partkey as page_id, upper(p_name) || case p_size % 4 when 0 then ' <{{<{{S|X}}>|K=' || upper(p_brand) || '}}>' when 1 then ' [[' || upper(p_type) || '|L <{{T}}>]]' when 2 then ' <nowiki>a</nowiki>!' else chr(10) || '== H <{{Z}}> ==' || chr(10) end as text from part""")
def map_nodes(spark, sf):
    """Text in capitals, templates in angle brackets, from the inside out; comments go, raw tags get a mark."""
    pages, nodes = _varied(spark, sf, F.col("p_name"), _turn(F.concat(F.lit(" {{{{s|x}}|k="), "p_brand", F.lit("}}")), F.concat(F.lit(" [["), "p_type", F.lit("|l {{t}}]]<!-- c -->")), " <nowiki>a</nowiki>", "\n== h {{z}} ==\n"))
    change = lambda kind, name, raw: F.when(kind == "text", F.upper(raw)).when(kind == "template", F.concat(F.lit("<"), raw, F.lit(">"))).when(kind == "comment", "").when(kind == "tag", F.concat(raw, F.lit("!"))).otherwise(raw)
    return edits.map_nodes(nodes, change).select("page_id", "text")


def _scoped(spark, sf) -> DataFrame:
    k = F.col("p_size")
    own = lambda m, *t: F.when(k % m == 0, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in t])).otherwise("")
    return _varied(
        spark, sf, F.concat(F.lit("P"), "p_partkey"), own(2, "{{T|K=", F.col("p_brand"), "[[X|V]]}}"), own(3, "[[", F.col("p_name"), "|L]]"), own(5, "<!--", F.col("p_type"), "-->"),
        own(2, '<nowiki class="A">', F.col("p_name"), "</nowiki>"), own(3, "{{{N|D}}}"), own(7, "[http://a.b E]"), "\nQ\n", own(3, "== ", F.col("p_brand"), "{{U}} =="),
    )


_SCOPES = {"prose": {}, "templates": {"templates": True}, "link_targets": {"link_targets": True}, "comments": {"comments": True}, "raw_tags": {"raw_tags": True}, "tag_attributes": {"raw_tags": True, "tag_attributes": True}, "no_headings": {"headings": False}}


@query("""with s as (select unnest(['prose', 'templates', 'link_targets', 'comments', 'raw_tags', 'tag_attributes', 'no_headings']) as scope)
    select p_partkey as page_id, scope, 'P' || cast(p_partkey as string) || case when p_size % 2 = 0 and scope = 'templates' then 'TK' || p_brand || 'V' else '' end
    || case when p_size % 3 = 0 then case when scope = 'link_targets' then p_name else '' end || 'L' else '' end || case when p_size % 5 = 0 and scope = 'comments' then p_type else '' end
    || case when p_size % 2 = 0 then case when scope = 'tag_attributes' then 'A' else '' end || case when scope in ('raw_tags', 'tag_attributes') then p_name else '' end else '' end
    || case when p_size % 3 = 0 then case when scope = 'templates' then 'N' else '' end || 'D' else '' end || case when p_size % 7 = 0 then 'E' else '' end || chr(10) || 'Q' || chr(10)
    || case when p_size % 3 = 0 and scope <> 'no_headings' then ' ' || p_brand || case when scope = 'templates' then 'U' else '' end || ' ' else '' end as text from part, s""")
def text_scopes(spark, sf):
    """The text of each page in seven scopes, the pieces joined in order."""
    nodes = _scoped(spark, sf)[1]
    out = None
    for name, flags in _SCOPES.items():
        own = edits.text_in(nodes, edits.Scope(**flags))
        own = own.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text")).select("page_id", F.lit(name).alias("scope"), "text")
        out = own if out is None else out.unionByName(own)
    return out


@query("""with s as (select unnest(['prose', 'templates', 'link_targets', 'comments', 'raw_tags', 'tag_attributes', 'no_headings']) as scope) select p_partkey as page_id, scope from part, s
    where p_size % 2 = 0 and scope in ('raw_tags', 'tag_attributes') and contains(p_name, 'red') or p_size % 3 = 0 and scope = 'link_targets' and contains(p_name, 'red') or p_size % 5 = 0 and scope = 'comments' and contains(p_type, 'red')
    or p_size % 3 = 0 and scope <> 'no_headings' and contains(p_brand, 'red') or p_size % 2 = 0 and scope = 'templates' and contains(p_brand, 'red')""")
def contains_text(spark, sf):
    """The pages that have a word in each of seven scopes."""
    nodes = _scoped(spark, sf)[1]
    out = None
    for name, flags in _SCOPES.items():
        own = edits.contains_text(nodes, "red", edits.Scope(**flags)).select("page_id", F.lit(name).alias("scope"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""select p_partkey as page_id, replace(p_name, 'red', '$1\\') || ' {{t|' || p_name || '}} [[' || p_name || '|' || replace(p_name, 'red', '$1\\') || ']]' as text from part""")
def replace_text(spark, sf):
    """A word replaced in prose, by a literal text."""
    pages, nodes = _varied(spark, sf, F.col("p_name"), " {{t|", F.col("p_name"), "}} [[", F.col("p_name"), "|", F.col("p_name"), "]]")
    return edits.applied(pages, nodes, edits.replace_text(nodes, "red", "$1\\"))


# --- runs -------------------------------------------------------------------------------------


def _outcomes(spark, sf):
    c = Catalog(spark, sf)
    source = table(spark, sf, "part").select(F.lit(0).alias("ns"), F.col("p_partkey").cast("string").alias("title"), F.col("p_partkey").alias("page_id"), "p_brand", "p_size")
    content = c["content"].select(F.lit(0).alias("ns"), F.col("page_id").cast("string").alias("title"), "text")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("{{bots|deny=Other, PageBot}}"), "p_brand")).when(F.col("p_size") % 3 == 1, F.lit("{{nobots|optout=x}}")).otherwise("p_brand")
    calls = wikitext.templates(wikitext.node_table(source.withColumn("text", text), "page_id"))
    denied = runs.policy(calls.select("page_id", F.col("start").alias("pos"), "name", F.col("args").alias("params")), "pagebot")
    done = source.where("page_id % 13 = 0")
    edit = F.when(F.col("page_id") % 4 != 0, F.replace("text", F.lit("red"), F.lit("crimson")))
    return runs.dry_run(source, content, edit, finished=done, denied=denied)


@query("""select cast(p_partkey as string) as title, case when p_partkey % 5 = 3 then 'missing' when p_size % 3 in (0, 1) or p_partkey % 4 = 0 then 'skipped' when p_name not like '%red%' then 'unchanged' else 'pending' end as outcome,
    case when p_partkey % 5 = 3 then null when p_size % 3 = 0 then '{{bots|deny=Other, PageBot}}' when p_size % 3 = 1 then '{{nobots}}' when p_partkey % 4 = 0 then 'no change needed' end as reason from part where p_partkey % 13 <> 0""")
def dry_run(spark, sf):
    return _outcomes(spark, sf).select("title", "outcome", "reason")


@query("""with o as (select case when p_partkey % 5 = 3 then 'missing' when p_size % 3 in (0, 1) or p_partkey % 4 = 0 then 'skipped' when p_name not like '%red%' then 'unchanged' else 'pending' end as outcome from part where p_partkey % 13 <> 0)
    select count(*) as processed, count(*) filter (outcome = 'pending') as pending, count(*) filter (outcome = 'unchanged') as unchanged, count(*) filter (outcome in ('skipped', 'missing')) as skipped,
    count(*) filter (outcome = 'missing') as missing, least(100, count(*) filter (outcome = 'missing')) as n_problems, count(*) filter (outcome = 'missing') > 100 as problems_truncated from o""")
def run_report(spark, sf):
    r = runs.report(_outcomes(spark, sf))
    return r.select("processed", "pending", "unchanged", "skipped", "missing", F.size("problems").cast("long").alias("n_problems"), "problems_truncated")


# --- dumps and streams ------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    import tempfile
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/pagelode-{uuid.uuid4().hex}"


@query("select doc_id as page_id, cast(doc_id % 3 as int) as ns, source || cast(doc_id as string) as title, md5(text) as digest from documents where doc_id % 3 in (0, 1)")
def read_dump(spark, sf):
    """Documents written as bzip2 dumps and read again, in two namespaces."""
    from pagelode.sources import dump

    path = _scratch(spark)
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("page_id"), (F.col("doc_id") % 3).cast("int").alias("ns"), F.concat("source", F.col("doc_id").cast("string")).alias("title"), "text")
    dump.write(rows.repartition(4), path, "bzip2")
    return dump.read(spark, path, [0, 1]).saved(f"{path}-pages").select("page_id", "ns", "title", F.md5("text").alias("digest"))


@query("select doc_id as page_id, cast(row_number() over (order by doc_id) as int) as nth from documents")
def ordered_dump(spark, sf):
    """The pages of a dump numbered as a sequential read meets them, from their splits and places."""
    from pagelode.sources import dump

    path = _scratch(spark)
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("ns"), F.col("doc_id").cast("string").alias("title"), "text")
    dump.write(rows.repartitionByRange(4, "page_id").sortWithinPartitions("page_id"), path)
    own = dump.read(spark, path).saved(f"{path}-pages")
    # ranks over all rows in two steps: inside a split, then over the splits' counts
    inside = own.withColumn("own", F.row_number().over(Window.partitionBy("file", "block").orderBy("place")))
    splits = own.groupBy("file", "block").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(splits, ["file", "block"]).select("page_id", (F.col("own") + F.col("before")).cast("int").alias("nth"))


@query("select event_id, cast(user_id as string) as title, event_id % 2 = 0 as is_bot from events where event_id % 7 <> 0")
def decode_events(spark, sf):
    from pagelode.streaming import events

    title = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.format_string('"title":"%d",', "user_id"))
    json = F.format_string('{%s"bot":%s,"revision":7,"meta":{"domain":"w","dt":"2024-01-01T00:00:00Z"}}', title, F.when(F.col("event_id") % 2 == 0, "true").otherwise("null"))
    raw = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("offset"), json.alias("payload"))
    return events.decode(raw).select(F.col("offset").cast("long").alias("event_id"), "title", "is_bot")


def _streamed(spark, sf, change: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """A query over events as a stream, run to its end; the sink is a table in the shared folder."""
    root = _scratch(spark)
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    own = change(stream).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
    own.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 10 minutes from events) group by all")
def stream_counts(spark, sf):
    """Hourly counts as a stream gives them: windows that the watermark has passed."""
    from pagelode.streaming import events

    return _streamed(spark, sf, lambda s: events.counts(s, by=["event_type"])).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select distinct event_id from events")
def stream_once(spark, sf):
    """Events delivered twice, kept once."""
    from pagelode.streaming import events

    twice = lambda s: events.once(s.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id"]).select("event_id")
    return _streamed(spark, sf, twice)


@query("select distinct cast(user_id as string) as page from events")
def stream_repeating(spark, sf):
    """The pages of a whole event stream, each once."""
    from pagelode.streaming import events

    return _streamed(spark, sf, lambda s: events.first_ever(s.select(F.col("user_id").cast("string").alias("page")), ["page"]))


# --- platform extras: the tables' own shape ---------------------------------------------------


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base, count(*) as n from lineitem where l_shipdate <= '1998-09-02' group by all""")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.count("*").alias("n"))


@query("select n_name, count(*) as orders, count(distinct c_custkey) as customers from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderstatus = 'F' group by n_name")
def orders_by_nation(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("customers"))


# --- more rewrites, wikis and scores ----------------------------------------------------------


@query("select p_partkey as page_id, case when p_size % 2 = 0 then '== A ==' || chr(10) || '=== B ===' || chr(10) || p_name else '== C ==' || chr(10) || p_type end as text from part")
def empty_sections(spark, sf):
    pages, nodes = _varied(spark, sf, _turn(F.concat(F.lit("== A ==\n=== B ===\n"), "p_name"), F.concat(F.lit("== A ==\n\n=== B ===\n\n== C ==\n"), "p_type")))
    return edits.applied(pages, nodes, edits.drop_empty_sections(nodes))


@query("select p_partkey as page_id, 'é &lt; &#124; &nbsp; – ' || p_name as text from part")
def html_entities(spark, sf):
    pages, nodes = _varied(spark, sf, "&eacute; &lt; &#124; &nbsp; &#8211; ", F.col("p_name"))
    return edits.applied(pages, nodes, edits.decode_entities(nodes))


@query("select p_partkey as page_id, '{{box|a|x=1}} == no' || chr(10) || '== H ==' || chr(10) || p_name || chr(10) || '== I ==' || chr(10) || 'z' as text from part")
def section_replacements(spark, sf):
    pages, nodes = _varied(spark, sf, "{{box|a|size=3|x=1}} == no\n== H ==\nold\n=== deep ===\nold\n== I ==\nz")
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), "p_name")
    new = edits.replace_section(nodes, "H", "NEW").drop("text").join(names, "page_id").withColumn("text", F.concat(F.lit("\n"), "p_name", F.lit("\n"))).drop("p_name")
    return edits.applied(pages, nodes, new.unionByName(edits.drop_parameter(nodes, ["Box"], "size")))


@query("""with t as (select *, lpad(cast(p_partkey as string), 9, '0') as s from part), w as (select *, list_sum(list_transform(range(1, 10), lambda i: (11 - i) * cast(s[i] as int))) as r, list_sum(list_transform(range(1, 10), lambda i: cast(s[i] as int) * case i % 2 when 1 then 3 else 1 end)) + 9 + 3 * 7 + 8 as q from t),
    c as (select *, case (11 - r % 11) % 11 when 10 then 'X' else cast((11 - r % 11) % 11 as string) end as d from w)
    select p_partkey as page_id, p_name || ' ISBN ' || case when p_size % 2 = 0 then '978' || s || cast((10 - q % 10) % 10 as string) else s || case d when '1' then '2' else '1' end end || ', {{x|ISBN ' || s || d || '}}' as text from c""")
def isbn_rewrites(spark, sf):
    """Valid ISBNs of ten digits in prose, written with thirteen; wrong ones and those in templates stay."""
    s = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    r = sum(((11 - i) * F.substring(s, i, 1).cast("int") for i in range(1, 10)), F.lit(0))
    check = (11 - r % 11) % 11
    d = F.when(check == 10, "X").otherwise(check.cast("string"))
    wrong = F.when(d == "1", "2").otherwise("1")
    pages, nodes = _varied(spark, sf, F.col("p_name"), " ISBN ", s, F.when(F.col("p_size") % 2 == 0, d).otherwise(wrong), ", {{x|ISBN ", s, d, "}}")
    return edits.applied(pages, nodes, edits.isbns_as_13(nodes))


@query("select n_nationkey, 'de' as language from nation where n_regionkey = 2 and n_nationkey % 3 <> 0")
def site_matrix(spark, sf):
    from pagelode.operators import wikis

    n = table(spark, sf, "nation")
    dim = n.select("n_nationkey", F.col("n_regionkey").cast("string").alias("family"), F.lit("de").alias("language"), (F.col("n_nationkey") % 3 == 0).alias("closed"), F.lit(False).alias("private"))
    return wikis.matrix(dim, "2", "de").select("n_nationkey", "language")


@query("""select r.rev_id, cast(l.quality as double) as score, case when l.doc_id is null then 'not scored' end as unscorable_reason from v_revision r left join labels l on l.doc_id = r.rev_id""")
def revision_scores(spark, sf):
    from pagelode.operators import wikis

    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("rev_id"), F.col("quality").cast("double").alias("probability"), F.lit(None).cast("string").alias("reason"))
    out = wikis.scored(Catalog(spark, sf)["revision"].select("rev_id"), scores)
    return out.select("rev_id", "result.score", "result.unscorable_reason")


# --- lookups of pages and files ---------------------------------------------------------------


#: Titles of the smaller tables, and one that no table has.
_LITERAL = ((0, "cold widget 0"), (1, "large widget 3"), (1, "hot gear 3"), (2, "small/bolt 5"), (4, "About"))


@query("""select p.page_id, t.ns, t.title, count(l.src_id) as n_links from (values (0, 'cold widget 0'), (1, 'large widget 3'), (1, 'hot gear 3'), (2, 'small/bolt 5'), (4, 'About')) as t(ns, title)
    left join v_page p on p.ns = t.ns and p.title = t.title left join v_links l on l.dst_id = p.page_id group by all""")
def literal_pages(spark, sf):
    """Titles given as text, found among the pages, with the links to each."""
    c = Catalog(spark, sf)
    counts = c["links"].groupBy(F.col("dst_id").alias("page_id")).agg(F.count("src_id").alias("n_links"))
    found = lookups.found(lookups.literal(spark, _LITERAL), c)
    return found.join(counts, "page_id", "left").select(*PAGE, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


@query("select page_id, ns, title from v_page where 1 = 0")
def no_pages(spark, sf):
    return lookups.found(lookups.literal(spark), Catalog(spark, sf))


@query("""select p.page_id, p.title, f.file_id from v_page p left join (select *, row_number() over (partition by title order by ts desc, file_id desc) as rn from v_file) f
    on f.title = replace(p.title, '/', ' ') and rn = 1 where p.ns = 1""")
def file_info(spark, sf):
    """The newest upload of the file that a page's title names, nulls without one."""
    asked = Catalog(spark, sf)["page"].where("ns = 1").select("page_id", F.col("title").alias("name"), F.replace("title", F.lit("/"), F.lit(" ")).alias("title"))
    return lookups.files(asked, Catalog(spark, sf)).select("page_id", F.col("name").alias("title"), "file_id")


@query("select page_id, title from v_page where page_id in (select src_id from v_imagelinks where dst_id = 7) and ns in (0, 1, 3)")
def file_usage(spark, sf):
    return lookups.file_usage(Catalog(spark, sf), 7, [0, 1, 3]).select("page_id", "title")


@query("select page_id, title from v_page where page_id in (select dst_id from v_imagelinks where src_id = 3)")
def files_on(spark, sf):
    return listing.links_from(Catalog(spark, sf), 3, "imagelinks").select("page_id", "title")


@query("select distinct ns, title from v_imagelinks join v_page on page_id = dst_id")
def all_file_usages(spark, sf):
    return listing.all_targets(Catalog(spark, sf), "imagelinks")


@query("select title, wiki, page_id from v_globalusage where wiki <> 'wiki0' and title in (select title from v_file where file_id % 4 = 0)")
def global_usage(spark, sf):
    c = Catalog(spark, sf)
    return lookups.global_usage(c["file"].where("file_id % 4 = 0"), c, own="wiki0")


@query("select title, ts, file_id from v_deleted_files where title >= 'b' and title <= 's' and title like 'r%'")
def deleted_files(spark, sf):
    return lookups.deleted_files(Catalog(spark, sf), "b", "s", "r")


@query("select distinct prefix, title from v_iwlinks where page_id = 7")
def interwiki_links(spark, sf):
    return lookups.interwiki_links(Catalog(spark, sf), 7)


@query("select page_id, action, level, cast(expiry as varchar) as expiry from v_protections where (expiry is null or expiry > date '1997-01-01') and page_id in (select page_id from v_page where ns = 1)")
def protections(spark, sf):
    c = Catalog(spark, sf)
    return lookups.protections(c["page"].where("ns = 1"), c, datetime.date(1997, 1, 1)).withColumn("expiry", F.col("expiry").cast("string"))


@query("select t.category, count(c.category) as size from (select distinct category from v_tracking) t left join v_categorylinks c on c.category = t.category group by t.category")
def tracking_categories(spark, sf):
    return lookups.tracking_categories(Catalog(spark, sf))


@query("select p.page_id, p.title, a.value from v_page p left join (select * from v_attributes where name = 'item') a on a.page_id = p.page_id where p.ns = 2")
def wikibase_items(spark, sf):
    c = Catalog(spark, sf)
    return lookups.attributes(c["page"].where("ns = 2").select("page_id", "title"), c, "item")


@query("select p.page_id, p.title, a.value from v_page p left join (select * from v_attributes where name = 'extract') a on a.page_id = p.page_id where p.ns = 0")
def extracts(spark, sf):
    c = Catalog(spark, sf)
    return lookups.attributes(c["page"].where("ns = 0").select("page_id", "title"), c, "extract")


@query("select page_id, level from v_proofread where page_id in (select page_id from v_page where is_redirect)")
def proofread_quality(spark, sf):
    c = Catalog(spark, sf)
    return lookups.proofread_quality(c["page"].where("is_redirect"), c)


@query("""select p.page_id, i.index_id from v_page p left join (select dst_id, min(src_id) as index_id from v_templatelinks where src_id in (select page_id from v_page where ns = 3) group by dst_id) i
    on i.dst_id = p.page_id where p.ns = 2""")
def index_of(spark, sf):
    c = Catalog(spark, sf)
    return lookups.index_of(c["page"].where("ns = 2"), c, 3)


@query("""select page_id, title, try_cast(nullif(regexp_extract(title, '/([0-9]{1,9})$', 1), '') as int) as number from v_page
    where ns = 2 and page_id in (select dst_id from v_templatelinks where src_id = 3)""")
def pages_of(spark, sf):
    return lookups.pages_of(Catalog(spark, sf), 3, 2)


# --- extensions -------------------------------------------------------------------------------


@query("select lint_id, category, page_id, ns, title from v_lint join v_page using (page_id) where category = 'missing-end-tag'")
def lint_errors(spark, sf):
    return extensions.lint_errors(Catalog(spark, sf), "missing-end-tag").select("lint_id", "category", "page_id", "ns", "title")


@query("select note_id, ts, type from v_notification where \"user\" = '3' and read is distinct from true")
def notifications(spark, sf):
    return extensions.notifications(Catalog(spark, sf), "3", unread_only=True).select("note_id", "ts", "type")


@query("""with s as (select page_id, rev_id as stable_id, max(level) as level from v_review where (page_id, rev_id) in (select (page_id, rev_id) from v_revision) group by page_id, rev_id
    qualify row_number() over (partition by page_id order by rev_id desc) = 1)
    select s.page_id, stable_id, cast(level as bigint) as level, max(rev_id) as latest_id, min_by(ts, rev_id) filter (rev_id > stable_id) as pending_since, count(*) filter (rev_id > stable_id) as n_pending
    from s join v_revision r on r.page_id = s.page_id group by all""")
def flagged(spark, sf):
    c = Catalog(spark, sf)
    return extensions.flagged(c["revision"].select("page_id"), c).withColumn("level", F.col("level").cast("long"))


@query("""select filter_id, case when not private then pattern end as pattern, private as hidden, (select count(*) from v_filter_hit h where h.filter_id = f.filter_id) as n_hits from v_filter f where enabled and not deleted""")
def abuse_filters(spark, sf):
    found = extensions.abuse_filters(Catalog(spark, sf), {"enabled": True, "deleted": False})
    return found.select("filter_id", "pattern", (F.size("redacted") == 1).alias("hidden"), "n_hits")


@query("select page_id, ts, creator from v_triage where ns = 1 and not reviewed and not is_redirect and creator in ('1-URGENT', '2-HIGH', '5-LOW') and creator <> '5-LOW'")
def new_pages(spark, sf):
    return extensions.new_pages(Catalog(spark, sf), 1, creators=["1-URGENT", "2-HIGH", "5-LOW"], hide_own="5-LOW").select("page_id", "ts", "creator")


@query("""select count(*) as pages, count(*) filter (reviewed) as reviewed, count(*) filter (not reviewed) as unreviewed, min(ts) filter (not reviewed) as oldest, count(*) filter (not reviewed and creator = '2-HIGH') as matching
    from v_triage where ns = 2""")
def triage_backlog(spark, sf):
    return extensions.backlog(Catalog(spark, sf), 2, ["2-HIGH"])


@query("""with a as (select name, wiki, sum(edits) as edits, max(attached) as attached, min(ts) as ts from v_account group by name, wiki),
    u as (select name, min_by(wiki, (ts, wiki)) filter (attached) as home, min(ts) filter (attached) as registered, cast(sum(edits) filter (attached) as bigint) as edits, string_agg(wiki, ' ' order by wiki) filter (attached) as merged,
          string_agg(wiki, ' ' order by wiki) filter (not attached) as unattached from a group by name)
    select u.name, home, registered, edits, merged, coalesce(unattached, '') as unattached, coalesce(g.groups, '') as groups from u
    left join (select name, string_agg(distinct grp, ' ' order by grp) as groups from v_global_groups group by name) g on g.name = u.name where home is not null""")
def global_users(spark, sf):
    c = Catalog(spark, sf)
    out = extensions.global_users(c["account"].select("name"), c)
    return out.withColumns({n: F.array_join(n, " ") for n in ("groups", "merged", "unattached")})


@query("""with x as (select distinct title from v_shared_file union select distinct replace(title, 'a', 'o') from v_file)
    select x.title, coalesce((select max('local') from v_file f where f.title = x.title), (select min(repository) from v_shared_file s where s.title = x.title)) as repository from x""")
def file_repositories(spark, sf):
    c = Catalog(spark, sf)
    asked = c["shared_file"].select("title").union(c["file"].select(F.replace("title", F.lit("a"), F.lit("o")).alias("title"))).distinct()
    return extensions.repositories_of(asked, c)


# --- logs and contributions with all arguments ------------------------------------------------


@query("""select rev_id from (select *, rev_id = max(rev_id) over (partition by page_id) as is_top from v_revision) where "user" = 'assistant' and ns in (0, 2) and minor and not "new" and tag = 'assistant' and is_top""")
def contributions_shown(spark, sf):
    c = Catalog(spark, sf)
    rows = c["revision"].withColumn("tags", F.array("tag", F.lit("all")))
    return activity.contributions(rows, "assistant", namespaces=[0, 2], flags={"minor": True, "new": False, "top": True}, tag="assistant").select("rev_id")


@query("select log_id, ts from v_log where type = 'view' and page_id = 7 and ns in (0, 1)")
def log_events_of_page(spark, sf):
    return activity.log_events(Catalog(spark, sf)["log"], "view", page_id=7, namespaces=[0, 1], order="oldest").select("log_id", "ts")


#: Log entries without their id, by remainder; # stands for the event's id.
_LOGS = (
    '"type":"move","title":"A","params":{"target_title":"B#","target_ns":"4","suppressredirect":true}',
    '"type":"move","title":"A","params":{}',
    '"type":"block","title":"A","params":{"duration":"# hours","expiry":"2024-01-02T03:04:05Z","flags":["nocreate",null,7,{}],"sitewide":"false"}',
    '"type":"block","title":"A","params":{"duration":"infinity","expiry":"infinity","flags":"x"}',
    '"type":"upload","title":"A","params":{"img_sha1":"s#"}',
    '"type":"protect","title":"A","params":{"description":"d#","details":[{"type":"edit","level":"sysop","expiry":"20240102030405","cascade":true},{"level":"x"},9,{"type":"move","expiry":"infinite"}]}',
    '"type":"rights","title":"A","params":{"oldgroups":["a","b"],"newgroups":["b","c","c","#"]}',
    '"type":"patrol","title":"A","params":{"curid":"#","previd":0,"auto":"true"}',
    '"type":"merge","title":"A","params":{"x":#,"y":[1],"z":null}',
    '"type":"delete","title":"A"',
    '"type":"delete","title":null',
)


@query("""select event_id as log_id, ['move', 'none', 'block', 'block', 'upload', 'protect', 'rights', 'patrol', 'unknown', 'none'][n + 1] as details,
    case n when 0 then 'B' || event_id || ' true' when 2 then event_id || ' hours 2024-01-02 03:04:05 nocreate,7 true' when 3 then 'infinity never  false' when 4 then 's' || event_id
    when 5 then 'd' || event_id || ' edit/sysop/2024-01-02 03:04:05/true move//never/false' when 6 then '+c,c,' || event_id || ' -a' when 7 then event_id || ' none true' when 8 then 'x=' || event_id else '' end as told
    from (select event_id, cast(event_id % 11 as int) as n from events) where n < 10""")
def log_variants(spark, sf):
    """Every variant of a log entry's parameters, written with the events' ids and decoded."""
    own = F.col("event_id").cast("string")
    made = F.replace(F.get(F.array(*map(F.lit, _LOGS)), (F.col("event_id") % 11).cast("int")), F.lit("#"), own)
    out = activity.decode_log(table(spark, sf, "events").select(F.concat(F.lit('{"logid":"'), own, F.lit('",'), made, F.lit("}")).alias("json")))
    until = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("never"))
    guard = lambda x: F.concat_ws("/", x["action"], x["level"], until(x["expiry"]), x["cascading"])
    spaced = lambda *c: F.concat_ws(" ", *c)
    told = {
        "move": spaced("target", "suppressed_redirect"),
        "block": spaced("duration", until(F.col("expiry")), F.array_join("flags", ","), "is_partial"),
        "upload": F.col("sha1"),
        "protect": spaced("description", F.array_join(F.transform("protections", guard), " ")),
        "rights": spaced(F.concat(F.lit("+"), F.array_join("groups_added", ",")), F.concat(F.lit("-"), F.array_join("groups_removed", ","))),
        "patrol": spaced("patrolled", F.coalesce(F.col("previous").cast("string"), F.lit("none")), "automatic"),
        "unknown": F.concat_ws(",", F.transform(F.map_entries("fields"), lambda x: F.concat_ws("=", x["key"], x["value"]))),
    }
    text = F.coalesce(*[F.when(F.col("details") == k, c) for k, c in told.items()], F.lit(""))
    return out.select("log_id", "details", text.alias("told"))
