"""What a wiki's extensions keep about pages, files and accounts, by joins and partial aggregates.

    lint            lint_id, page_id, category, ...     problems found in pages
    notification    note_id, user, ts, read, ...
    review          page_id, rev_id, level              reviewed revisions
    filter          filter_id, pattern, private, ...    abuse filters and their states as flags
    filter_hit      filter_id
    triage          page_id, ns, ts, reviewed, is_redirect, creator
    account         name, wiki, edits, attached, ts     local accounts of global ones
    global_groups   name, grp
    shared_file     title, repository                   files of shared repositories

Null keys meet nothing. Empty tables give empty tables; an asked row without an answer is absent where
no other rule is stated.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.operators.listing import Catalog, _top, latest_file, new_page_stats, show
from pagelode.operators.pageset import in_namespaces


def lint_errors(cat: Catalog, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Problems with their page's namespace and title, by id."""
    rows = cat["lint"] if category is None else cat["lint"].where(F.col("category") == category)
    return _top(rows.join(cat["page"].select("page_id", "ns", "title"), "page_id"), [F.col("lint_id")], limit)


def notifications(cat: Catalog, user: object, unread_only: bool = False, limit: int | None = None) -> DataFrame:
    """A user's notifications, newest first; a null read is unread."""
    rows = cat["notification"].where(F.col("user") == user)
    if unread_only:
        rows = rows.where(~F.coalesce("read", F.lit(False)))
    return _top(rows, [F.desc("ts"), F.desc("note_id")], limit)


def flagged(asked: DataFrame, cat: Catalog) -> DataFrame:
    """(page_id, stable_id, level, latest_id, pending_since, n_pending) of asked pages with a reviewed revision.

    The stable revision is the newest reviewed one, with the highest level of its reviews; pending are the
    revisions after it, since the time of the first. Reviews of revisions that are gone don't count.
    """
    pages = asked.select("page_id").distinct()
    reviews = cat["review"].join(pages, "page_id", "left_semi").groupBy("page_id", "rev_id").agg(F.max("level").alias("level"))
    revisions = cat["revision"].select("page_id", "rev_id", "ts").join(pages, "page_id", "left_semi")
    stable = reviews.join(revisions.select("page_id", "rev_id"), ["page_id", "rev_id"], "left_semi").groupBy("page_id").agg(F.max(F.struct("rev_id", "level")).alias("stable"))
    later = F.col("rev_id") > F.col("stable.rev_id")
    pending = revisions.join(stable, "page_id").groupBy("page_id", "stable").agg(F.max("rev_id").alias("latest_id"), F.min(F.when(later, F.struct("rev_id", "ts"))).alias("first"), F.count_if(later).alias("n_pending"))
    return pending.select("page_id", F.col("stable.rev_id").alias("stable_id"), F.col("stable.level").alias("level"), "latest_id", F.col("first.ts").alias("pending_since"), "n_pending")


def abuse_filters(cat: Catalog, flags: Mapping[str, bool | None] | None = None, may_view_private: bool = False, lowest_first: bool = True, limit: int | None = None) -> DataFrame:
    """Filters by id with n_hits. What may not be seen is null and named in redacted, so that it isn't taken for empty."""
    hidden = F.coalesce("private", F.lit(False)) & F.lit(not may_view_private)
    rows = cat["filter"].where(show(flags or {})).withColumn("redacted", F.when(hidden, F.array(F.lit("pattern"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("pattern", F.when(~hidden, F.col("pattern")))
    hits = cat["filter_hit"].groupBy("filter_id").agg(F.count("*").alias("n_hits"))
    rows = rows.join(hits, "filter_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    return _top(rows, [F.col("filter_id") if lowest_first else F.desc("filter_id")], limit)


def _triage(cat: Catalog, namespace: int, creators: Iterable[str], hide_own: str | None) -> DataFrame:
    rows = cat["triage"].transform(in_namespaces([namespace]))
    names = list(creators)
    if names:
        rows = rows.where(F.col("creator").isin(names))
    return rows if hide_own is None else rows.where(~F.col("creator").eqNullSafe(F.lit(hide_own)))


def new_pages(cat: Catalog, namespace: int = 0, reviewed: bool | None = False, redirects: bool = False, creators: Iterable[str] = (), hide_own: str | None = None, newest_first: bool = True, limit: int | None = None) -> DataFrame:
    """Pages that wait for review, or were reviewed, or both (None); hide_own leaves out the pages of an account."""
    rows = _triage(cat, namespace, creators, hide_own).where(show({"reviewed": reviewed}))
    if not redirects:
        rows = rows.where(~F.coalesce("is_redirect", F.lit(False)))
    order = [F.desc("ts"), F.desc("page_id")] if newest_first else [F.col("ts"), F.col("page_id")]
    return _top(rows, order, limit)


def backlog(cat: Catalog, namespace: int = 0, creators: Iterable[str] = (), hide_own: str | None = None) -> DataFrame:
    """One row: new_page_stats() of a namespace, and matching: its unreviewed pages of the creators."""
    own = _triage(cat, namespace, creators, hide_own).where(~F.col("reviewed")).agg(F.count("*").alias("matching"))
    return new_page_stats(_triage(cat, namespace, (), None)).crossJoin(own)  # one row by one row


def global_users(asked: DataFrame, cat: Catalog) -> DataFrame:
    """(name, home, registered, edits, groups, merged, unattached) of the asked names that have an attached account.

    Home is the wiki of the first attached account, by name among equal times; edits are those of the
    attached ones. merged and unattached are sorted lists of wikis, as long as a farm has wikis.
    """
    names = asked.select("name").distinct()
    own = cat["account"].join(names, "name", "left_semi").groupBy("name", "wiki").agg(F.sum("edits").alias("edits"), F.max("attached").alias("attached"), F.min("ts").alias("ts"))
    wikis = lambda on: F.sort_array(F.collect_list(F.when(F.col("attached") == on, F.col("wiki"))))
    found = own.groupBy("name").agg(
        F.min(F.when(F.col("attached"), F.struct("ts", "wiki"))).alias("first"), F.sum(F.when(F.col("attached"), F.col("edits"))).alias("edits"), wikis(True).alias("merged"), wikis(False).alias("unattached")
    )
    groups = cat["global_groups"].join(names, "name", "left_semi").groupBy("name").agg(F.sort_array(F.collect_set("grp")).alias("groups"))
    rows = found.where("first is not null").join(groups, "name", "left")
    return rows.select("name", F.col("first.wiki").alias("home"), F.col("first.ts").alias("registered"), "edits", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), "merged", "unattached")


def repositories_of(asked: DataFrame, cat: Catalog) -> DataFrame:
    """The asked titles with repository: 'local' for an own file, else the first shared repository by name that has it, else null."""
    shared = cat["shared_file"].groupBy("title").agg(F.min("repository").alias("shared_"))
    local = latest_file(cat["file"]).select("title", F.lit("local").alias("local_"))
    rows = asked.join(local, "title", "left").join(shared, "title", "left")
    return rows.withColumn("repository", F.coalesce("local_", "shared_")).drop("local_", "shared_")
