"""Wiki-shaped views over the driver's tables: one SQL text for Spark and for the oracle.

Parts stand for pages, line items for links, customers for category members and users, conversations
for revisions, events for recent changes and page views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelode.session import TABLES, table

VIEWS = {
    "page": "select p_partkey as page_id, cast(p_size % 4 as int) as ns, concat(case when p_partkey % 3 = 0 then p_name else replace(p_name, ' ', '/') end, ' ', cast(p_partkey % 700 as string)) as title, "
    "p_partkey % 7 = 0 as is_redirect, cast(p_size as bigint) as len from {part}",
    "content": "select p_partkey as page_id, cast(p_size % 4 as int) as ns, concat(case when p_partkey % 3 = 0 then p_name else replace(p_name, ' ', '/') end, ' ', cast(p_partkey % 700 as string)) as title, "
    "concat(p_name, ' of ', p_brand, ' and ', p_type) as text from {part} where p_partkey % 5 <> 3",
    "article": "select doc_id as page_id, cast(doc_id % 4 as int) as ns, concat(case doc_id % 3 when 0 then 'Москва ' when 1 then 'Café Noir ' else 'Plain ' end, cast(doc_id % 50 as string)) as title, "
    "concat(coalesce(text, ''), case when doc_id % 5 = 0 then ' Москва и её ДОМ' when doc_id % 7 = 0 then ' un Café noir' when doc_id % 11 = 0 then ' noir café' else '' end) as text, n_chars as ts, doc_id % 97 as created from {documents}",
    "links": "select l_suppkey as src_id, l_partkey as dst_id from {lineitem} where l_partkey % 9 <> 4",
    "templatelinks": "select l_suppkey as src_id, l_partkey as dst_id from {lineitem} where l_returnflag = 'A'",
    "redirect": "select p_partkey as src_id, cast(p_partkey % 50 as bigint) as dst_id from {part} where p_partkey % 7 = 0",
    "categorylinks": "select c_custkey as page_id, n_name as category, c_name as sortkey, c_acctbal as ts, "
    "case c_mktsegment when 'BUILDING' then 'subcat' when 'MACHINERY' then 'file' else 'page' end as type from {customer} join {nation} on c_nationkey = n_nationkey",
    "externallinks": "select page_id, url from {pages}",
    "langlinks": "select doc_id as page_id, case when doc_id % 9 = 0 then ' ' else lang end as lang, source as title from {documents}",
    "page_props": "select doc_id as page_id, case when quality = 1 then 'good' else 'plain' end as property, toxic from {labels}",
    "watchlist": "select o_custkey as page_id, o_orderpriority as user from {orders}",
    "protected_titles": "select cast(p_size % 4 as int) as ns, p_name as title, p_type as level from {part} where p_partkey % 11 = 0",
    "revision": "select conv_id * 100 + turn as rev_id, conv_id as page_id, turn as ts, case when role = 'system' then cast(null as string) else role end as user, cast(length(text) as bigint) as size, text, cast(conv_id % 4 as int) as ns, length(text) < 900 as minor, turn % 3 = 0 as new, role as tag from {conversations}",
    "version": "select doc_id * 2 as rev_id, doc_id as page_id, coalesce(text, '') as text from {documents} union all "
    "select doc_id * 2 + 1 as rev_id, doc_id as page_id, concat('Version of ', source, chr(10), replace(coalesce(text, ''), '. ', concat('.', chr(10))), case when doc_id % 3 = 0 then concat(chr(10), lang) else '' end) as text from {documents}",
    "recentchanges": "select event_id as rc_id, ts, user_id as page_id, cast(user_id % 10 as string) as user, event_type as type, cast(event_id % 3 as int) as ns, event_id % 5 = 0 as bot, event_id % 2 = 0 as minor, value from {events}",
    "log": "select event_id as log_id, ts, event_type as type, case when value > 20 then 'big' else 'small' end as action, user_id as user, user_id as page_id, cast(event_id % 3 as int) as ns from {events}",
    "user": "select c_custkey as user_id, c_name as name, c_mktsegment as grp, cast(floor(c_acctbal) as bigint) as edits from {customer}",
    "block": "select o_orderkey as block_id, o_orderdate as ts, o_orderstatus as user, o_totalprice > 250000 as auto, o_custkey % 2 = 0 as temporary from {orders}",
    "file": "select p_partkey as file_id, p_name as title, p_size as ts, concat(p_brand, p_type) as sha1 from {part}",
    "imagelinks": "select l_suppkey as src_id, l_partkey as dst_id from {lineitem} where l_returnflag = 'R'",
    "globalusage": "select p_name as title, concat('wiki', cast(p_size % 5 as string)) as wiki, p_partkey as page_id from {part}",
    "deleted_files": "select p_name as title, p_size as ts, p_partkey as file_id from {part} where p_partkey % 6 = 1",
    "iwlinks": "select doc_id % 40 as page_id, lang as prefix, source as title from {documents}",
    "protections": "select o_custkey as page_id, o_orderpriority as action, o_orderstatus as level, case when o_orderkey % 3 = 0 then cast(null as date) else cast(o_orderdate as date) end as expiry from {orders}",
    "tracking": "select n_name as category from {nation} where n_nationkey % 2 = 0 union all select r_name as category from {region}",
    "attributes": "select doc_id as page_id, 'item' as name, source as value from {documents} where doc_id % 3 = 0 union all select doc_id as page_id, 'extract' as name, lang as value from {documents}",
    "proofread": "select p_partkey as page_id, cast(p_size % 5 as int) as level from {part} where p_size % 4 = 2",
    "geo": "select c_custkey as page_id, (c_custkey * 37 % 1800) / 10.0 - 90 as lat, (c_custkey * 91 % 3600) / 10.0 - 180 as lon from {customer}",
    "triage": "select o_orderkey as page_id, cast(o_orderkey % 4 as int) as ns, o_orderdate as ts, o_orderstatus = 'F' as reviewed, o_orderkey % 5 = 0 as is_redirect, o_orderpriority as creator from {orders}",
    "lint": "select l_orderkey * 10 + l_linenumber as lint_id, l_partkey as page_id, case when l_quantity < 10 then 'obsolete-tag' when l_quantity < 30 then 'missing-end-tag' else 'self-closed-tag' end as category from {lineitem}",
    "notification": "select event_id as note_id, cast(user_id % 10 as string) as user, ts, event_type as type, case when event_id % 7 = 0 then cast(null as boolean) else value > 10 end as read from {events}",
    "review": "select conv_id as page_id, conv_id * 100 + turn as rev_id, length(text) % 3 as level from {conversations} where turn % 2 = 1 and conv_id % 4 <> 1 union all select conv_id as page_id, conv_id * 100 + 99 as rev_id, 9 as level from {conversations}",
    "filter": "select s_suppkey as filter_id, s_name as pattern, s_acctbal < 0 as private, s_nationkey % 3 <> 0 as enabled, s_nationkey % 5 = 1 as deleted from {supplier}",
    "filter_hit": "select l_suppkey as filter_id from {lineitem} where l_suppkey % 6 <> 2",
    "account": "select concat('User ', cast(o_custkey % 211 as string)) as name, concat('wiki', cast(o_orderkey % 9 as string)) as wiki, o_orderkey % 100 as edits, o_orderkey % 9 <> 4 and o_custkey % 211 <> 5 as attached, o_orderdate as ts from {orders}",
    "global_groups": "select concat('User ', cast(c_custkey % 400 as string)) as name, c_mktsegment as grp from {customer} where c_custkey % 3 = 0",
    "shared_file": "select concat('shared ', s_name) as title, concat('repo', cast(s_nationkey % 4 as string)) as repository from {supplier} union all select p_name as title, 'repo0' as repository from {part} where p_partkey % 2 = 0",
    "views": "select 'en.wikipedia' as project, cast(user_id as string) as title, case when event_id % 3 = 0 then 'mobile-web' else 'desktop' end as access, "
    "case when event_type = 'error' then 'spider' else 'user' end as agent, ts, cast(event_id % 17 as bigint) as views from {events}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


class Catalog(dict):
    """Views by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        got = self[name] = view(self.spark, self.sf_dir, name)
        return got


def with_views(sql: str) -> str:
    """The oracle's SQL with the views that it names in front."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b(from|join) v_{v}\b", sql)]
    ctes = [f"v_{v} as ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used]
    if not ctes:
        return sql
    body = sql.strip()
    return "with " + ", ".join(ctes) + (", " + body[5:] if body.lower().startswith("with ") else " " + body)
