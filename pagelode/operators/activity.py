"""Histories, recent changes and log events."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import jsons, scalars
from pagelode.operators.diffs import with_parent
from pagelode.operators.listing import _between, _top, show
from pagelode.operators.pageset import in_namespaces


def _ordered(df: DataFrame, order: str, ts: str, id_col: str, limit: int | None) -> DataFrame:
    if order not in ("newest", "oldest"):
        raise ValueError("order must be newest or oldest")
    by = F.desc if order == "newest" else F.asc
    return _top(df, [by(ts), by(id_col)], limit)


def history(revisions: DataFrame, page_id: int | None = None, order: str = "newest", start: object | None = None, end: object | None = None, user: str | None = None, exclude_user: str | None = None, namespaces: Iterable[int] = (), limit: int | None = None) -> DataFrame:
    """Revisions of a page, or of all; a hidden (null) user is nobody's and excluded by no name.

    Deleted revisions are a table of their own with the same columns. Namespaces need a column ns.
    """
    rows = revisions.where(_between("ts", start, end)).transform(in_namespaces(namespaces))
    if page_id is not None:
        rows = rows.where(F.col("page_id") == page_id)
    if user is not None:
        rows = rows.where(F.col("user") == user)
    if exclude_user is not None:
        rows = rows.where(~F.col("user").eqNullSafe(exclude_user))
    return _ordered(rows, order, "ts", "rev_id", limit)


def by_id(revisions: DataFrame, ids: DataFrame) -> DataFrame:
    return revisions.join(ids.select("rev_id"), "rev_id", "left_semi")


def content_at(revisions: DataFrame, asked: DataFrame, width: int | float | None = None) -> DataFrame:
    """asked (page_id, at, ...) with the columns of the page's last revision at or before that time; null where none is.

    revisions: page_id, ts, rev_id, ...; the larger rev_id wins among equal times. Times are numbers or
    timestamps. A page's time is cut into ranges of a width (a 4096th of all time if none is given), so a
    page with a third of all revisions is dealt over its ranges: inside a range the last revision is carried
    from row to row, and what a range begins with is the last of the ranges before it, of which a page has a
    bounded count. Only ids are carried; the contents are joined at the end. Null times are never met.
    """
    number = lambda c: F.col(c).cast("double")
    own = revisions.where("page_id is not null and ts is not null and rev_id is not null").select("page_id", number("ts").alias("t"), "rev_id")
    wanted = asked.where("page_id is not null and at is not null").select("page_id", number("at").alias("t")).distinct()
    if width is None:
        low, high = own.agg(F.min("t"), F.max("t")).first()
        width = max((high - low) / 4096, 1e-9) if low is not None else 1.0
    at = F.floor(F.col("t") / F.lit(float(width))).alias("range")
    own, wanted = own.select("*", at), wanted.select("*", at)
    last = own.groupBy("page_id", "range").agg(F.max(F.struct("t", "rev_id")).alias("last"))
    ranges = last.unionByName(wanted.select("page_id", "range").distinct(), allowMissingColumns=True).groupBy("page_id", "range").agg(F.max("last").alias("last"))
    before = Window.partitionBy("page_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begin = ranges.select("page_id", "range", F.max("last").over(before).alias("begin"))
    inside = Window.partitionBy("page_id", "range").orderBy("t", F.col("rev_id").isNull(), "rev_id")
    rows = own.unionByName(wanted, allowMissingColumns=True)
    met = rows.withColumn("here", F.last("rev_id", ignorenulls=True).over(inside)).where("rev_id is null").join(begin, ["page_id", "range"])
    found = met.select("page_id", "t", F.coalesce("here", "begin.rev_id").alias("rev_id"))
    content = revisions.drop(*[c for c in asked.columns if c not in ("rev_id",)]).dropDuplicates(["rev_id"])
    out = asked.withColumn("t", number("at")).join(found, ["page_id", "t"], "left").drop("t")
    return out.join(content, "rev_id", "left")


def latest_of(rows: DataFrame, by: list[str], ts: str, id_col: str) -> DataFrame:
    """The newest row of each group, found by a partial aggregate; the larger id wins a tie."""
    rest = [c for c in rows.columns if c not in (*by, ts, id_col)]
    return rows.groupBy(*by).agg(F.max(F.struct(ts, id_col, *rest)).alias("_last")).select(*by, "_last.*").select(*rows.columns)


def recent_changes(changes: DataFrame, namespaces: Iterable[int] = (), types: Iterable[str] = (), user: object | None = None, flags: Mapping[str, bool | None] | None = None, tag: str | None = None, top_only: bool = False, order: str = "newest", start: object | None = None, end: object | None = None, limit: int | None = None) -> DataFrame:
    rows = changes.where(_between("ts", start, end) & show(flags or {})).transform(in_namespaces(namespaces))
    wanted = list(types)
    if wanted:
        rows = rows.where(F.col("type").isin(wanted))
    if user is not None:
        rows = rows.where(F.col("user") == user)
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    if top_only:
        rows = latest_of(rows, ["page_id"], "ts", "rc_id")
    return _ordered(rows, order, "ts", "rc_id", limit)


def watchlist_changes(changes: DataFrame, watched: DataFrame, all_revisions: bool = False, **kw) -> DataFrame:
    """Changes of watched pages; without all_revisions the newest of each page."""
    own = changes.join(watched.select("page_id"), "page_id", "left_semi")
    return recent_changes(own, top_only=not all_revisions, **kw)


def contributions(revisions: DataFrame, user: str, start: object | None = None, end: object | None = None, limit: int | None = None, namespaces: Iterable[int] = (), flags: Mapping[str, bool | None] | None = None, tag: str | None = None) -> DataFrame:
    """A user's revisions with is_top: whether each is its page's newest. Only pages that the user has are aggregated.

    Namespaces, flags and tag need the columns ns, those named and tags; the flag top asks for is_top.
    """
    asked = dict(flags or {})
    top = asked.pop("top", None)
    own = revisions.where((F.col("user") == user) & _between("ts", start, end) & show(asked)).transform(in_namespaces(namespaces))
    if tag is not None:
        own = own.where(F.array_contains("tags", tag))
    theirs = revisions.select("page_id", "ts", "rev_id").join(own.select("page_id").distinct(), "page_id", "left_semi")
    rows = own.join(theirs.groupBy("page_id").agg(F.max(F.struct("ts", "rev_id"))["rev_id"].alias("_top")), "page_id")
    rows = rows.withColumn("is_top", F.col("rev_id") == F.col("_top")).drop("_top")
    return _ordered(rows if top is None else rows.where(F.col("is_top") == top), "newest", "ts", "rev_id", limit)


def log_events(events: DataFrame, kind: str | None = None, action: str | None = None, user: object | None = None, order: str = "newest", start: object | None = None, end: object | None = None, limit: int | None = None, page_id: object | None = None, namespaces: Iterable[int] = ()) -> DataFrame:
    rows = events.where(_between("ts", start, end)).transform(in_namespaces(namespaces))
    for column, value in (("type", kind), ("action", action), ("user", user), ("page_id", page_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return _ordered(rows, order, "ts", "log_id", limit)


LOG_DETAILS = ("move", "block", "upload", "protect", "rights", "patrol")


def decode_log(json: DataFrame, column: str = "json") -> DataFrame:
    """Log entries from JSON, decoded tolerantly: a field of the wrong shape is null, rows without a title go.

    details names the variant, one of LOG_DETAILS, "none" (no parameters) or "unknown"; a move without a
    target is one of the last two. Columns of other variants are null. Revision 0 is null; a missing time is
    the epoch; groups gone and new keep repeats; a block is partial only if it says that it isn't sitewide,
    and has no expiry if it never ends; protections without an action go. The parameters of unknown types
    stay as texts in fields, and as JSON in raw.
    """
    e = json.select(F.get_json_object(column, "$.params").alias("params_text"), jsons.parse(column).alias("e")).withColumn("p", jsons.obj(F.col("e"), "params"))
    own, params = F.col("e"), F.col("p")
    rows = e.withColumns({"type": jsons.string(own, "type"), "title": jsons.string(own, "title"), "target": jsons.string(params, "target_title"), "fields": F.coalesce(jsons.texts(params), F.create_map().cast("map<string,string>"))})
    rows = rows.where("title is not null")
    empty = F.coalesce(F.size(F.try_variant_get(params, "$", "map<string,variant>")) == 0, F.lit(True))
    other = F.when(empty, F.lit("none")).otherwise(F.lit("unknown"))
    named = F.col("type").isin(*LOG_DETAILS) & ((F.col("type") != "move") | (F.trim(F.coalesce("target", F.lit(""))) != ""))
    rows = rows.withColumn("details", F.when(named, F.col("type")).otherwise(other))
    rows = rows.withColumns({"before": jsons.strings(params, "oldgroups"), "after": jsons.strings(params, "newgroups")})
    less = lambda a, b: F.filter(F.col(a), lambda x: ~F.array_contains(F.col(b), x))
    positive = lambda c: F.nullif(c, F.lit(0).cast("long"))
    only = lambda kind, c: F.when(F.col("details") == kind, c)

    def protection(x: Column) -> Column:
        expiry = jsons.string(x, "expiry")
        never = expiry.isNull() | F.coalesce(scalars.is_never(expiry), F.lit(False))
        return F.struct(jsons.string(x, "type").alias("action"), F.coalesce(jsons.string(x, "level"), F.lit("")).alias("level"), F.when(~never, scalars.parse_timestamp(expiry)).alias("expiry"), jsons.flag(x, "cascade").alias("cascading"))

    protections = F.filter(F.transform(jsons.objects(params, "details"), protection), lambda x: x["action"].isNotNull())
    return rows.select(
        jsons.long(own, "logid").alias("log_id"), "type", jsons.string(own, "action").alias("action"), jsons.integer(own, "ns").alias("ns"), "title", jsons.string(own, "user").alias("user"),
        F.coalesce(jsons.time(own, "timestamp"), F.timestamp_seconds(F.lit(0))).alias("ts"), jsons.string(own, "comment").alias("comment"), jsons.strings(own, "tags").alias("tags"),
        positive(jsons.long(own, "revid")).alias("rev_id"), positive(jsons.long(own, "old_revid")).alias("old_rev_id"), (jsons.long(own, "newlen") - jsons.long(own, "oldlen")).alias("size_change"),
        jsons.flag(own, "bot").alias("is_bot"), jsons.flag(own, "minor").alias("is_minor"), "details",
        only("move", F.col("target")).alias("target"), only("move", jsons.flag(params, "suppressredirect")).alias("suppressed_redirect"),
        only("block", jsons.string(params, "duration")).alias("duration"), only("block", jsons.time(params, "expiry")).alias("expiry"), only("block", jsons.strings(params, "flags")).alias("flags"),
        only("block", F.coalesce(~jsons.boolean(params, "sitewide"), F.lit(False))).alias("is_partial"), only("upload", jsons.string(params, "img_sha1")).alias("sha1"),
        only("protect", protections).alias("protections"), only("protect", jsons.string(params, "description")).alias("description"),
        only("rights", less("after", "before")).alias("groups_added"), only("rights", less("before", "after")).alias("groups_removed"),
        only("patrol", F.coalesce(jsons.long(params, "curid"), F.lit(0).cast("long"))).alias("patrolled"), only("patrol", positive(jsons.long(params, "previd"))).alias("previous"), only("patrol", jsons.flag(params, "auto")).alias("automatic"),
        only("unknown", F.col("fields")).alias("fields"), only("unknown", F.col("params_text")).alias("raw"),
    )


def compare(revisions: DataFrame) -> DataFrame:
    """For each revision with one before it: lines added and removed, as bags of lines."""
    pairs = with_parent(revisions.select("page_id", "rev_id", "text"), before="text").where("parent_id is not null")
    lines = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n")
    both = pairs.select("page_id", "rev_id", "parent_id", F.explode(F.concat(F.transform(lines("text"), lambda x: F.struct(x.alias("line"), F.lit(1).alias("sign"))), F.transform(lines("before"), lambda x: F.struct(x.alias("line"), F.lit(-1).alias("sign"))))).alias("x"))
    net = both.groupBy("page_id", "rev_id", "parent_id", "x.line").agg(F.sum("x.sign").alias("n"))
    return net.groupBy("page_id", "rev_id", "parent_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def user_has(rights: str | Column, right: str) -> Column:
    return F.array_contains(rights, right)


def allows(actions: str, action: str) -> Column:
    """An action is allowed if it was asked about and has no reasons against it."""
    return F.coalesce(F.size(F.try_element_at(F.col(actions), F.lit(action))) == 0, F.lit(False))
