"""Page-view series: rows (project, title, access, agent, ts, views)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRANULARITIES = {"hourly": "hour", "daily": "day", "monthly": "month"}


def decode(items: DataFrame, column: str = "json") -> DataFrame:
    """Series items from JSON: rows with an unreadable hour go, a missing count is 0."""
    from pagelode.functions.scalars import instant_of

    e = items.withColumn("e", F.from_json(column, "project string, article string, granularity string, timestamp string, access string, agent string, views long"))
    out = e.select("e.project", F.col("e.article").alias("title"), "e.access", "e.agent", instant_of(F.col("e.timestamp")).alias("ts"), F.coalesce("e.views", F.lit(0)).alias("views"))
    return out.where("ts is not null")


def _series(rows: DataFrame, start: object, end: object, access: str | None, agent: str | None) -> DataFrame:
    if str(start) > str(end):
        raise ValueError("start must not be after end")
    rows = rows.where((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
    if access:
        rows = rows.where(F.col("access") == access)
    return rows.where(F.col("agent") == agent) if agent else rows


def per_article(rows: DataFrame, project: str, title: str, start: object, end: object, granularity: str = "daily", access: str | None = None, agent: str | None = None) -> DataFrame:
    """Oldest first; empty periods don't appear; hourly counts are not kept by article."""
    if granularity not in ("daily", "monthly"):
        raise ValueError("granularity must be daily or monthly")
    own = rows.where((F.col("project") == project) & (F.col("title") == title))
    return _sums(_series(own, start, end, access, agent), granularity, ["title"]).orderBy("ts")


def aggregate(rows: DataFrame, project: str, start: object, end: object, granularity: str = "daily", access: str | None = None, agent: str | None = None) -> DataFrame:
    own = _series(rows.where(F.col("project") == project), start, end, access, agent)
    return _sums(own, granularity, []).orderBy("ts")


def _sums(rows: DataFrame, granularity: str, by: list[str]) -> DataFrame:
    at = F.date_trunc(GRANULARITIES[granularity], "ts").alias("ts")
    return rows.groupBy(*by, at).agg(F.sum("views").alias("views"))


def top(rows: DataFrame, project: str, day: object, n: int = 1000, granularity: str = "daily", access: str | None = None) -> DataFrame:
    """The most viewed titles of a day or month by people, with equal ranks for equal counts; n is at most 1000.

    The n first by count are taken before ranks are given, so no task ranks all titles.
    """
    if not 1 <= n <= 1000:
        raise ValueError("n must be 1 to 1000")
    unit = GRANULARITIES[granularity]
    own = rows.where((F.col("project") == project) & (F.date_trunc(unit, "ts") == F.date_trunc(unit, F.lit(day).cast("timestamp"))) & (F.col("agent") == "user"))
    if access:
        own = own.where(F.col("access") == access)
    most = own.groupBy("title").agg(F.sum("views").alias("views")).orderBy(F.desc("views"), "title").limit(n)
    return most.withColumn("rank", F.rank().over(Window.orderBy(F.desc("views"))))


def for_pages(pages: DataFrame, rows: DataFrame, start: object, end: object) -> DataFrame:
    """(title, series): for every distinct page its counts by day, oldest first; pages without any have an empty list."""
    own = _sums(_series(rows, start, end, None, None), "daily", ["title"])
    lists = own.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("ts", "views"))).alias("series"))
    out = pages.select("title").distinct().join(lists, "title", "left")
    return out.withColumn("series", F.coalesce("series", F.array().cast(lists.schema["series"].dataType)))
