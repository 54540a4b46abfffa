"""The dimension of wikis, scores of models, and what a wiki's pages say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(wikis: DataFrame, family: str | None = None, language: str | None = None, open_only: bool = True) -> DataFrame:
    """Wikis (db_name, family, language, closed, private) of a family or language; closed and private ones on demand."""
    rows = wikis.where(F.col("family") == family) if family else wikis
    rows = rows.where(F.col("language") == language) if language else rows
    return rows.where("not closed and not private") if open_only else rows


def languages_of(wikis: DataFrame, family: str) -> DataFrame:
    return matrix(wikis, family, open_only=False).select("language").distinct()


def scored(revisions: DataFrame, scores: DataFrame) -> DataFrame:
    """Revisions with result struct<score, unscorable_reason>: from a table of (rev_id, probability, reason) that a model has filled.

    A revision without a row is unscorable for want of one; calling a remote model is not part of this.
    """
    rows = revisions.join(scores.select("rev_id", "probability", F.col("reason").alias("_reason"), F.lit(True).alias("_there")), "rev_id", "left")
    reason = F.when(F.col("probability").isNull(), F.coalesce("_reason", F.when(F.col("_there").isNull(), "not scored").otherwise("no probability")))
    return rows.withColumn("result", F.struct(F.col("probability").alias("score"), reason.alias("unscorable_reason"))).drop("probability", "_reason", "_there")


def endpoint(html: Column) -> Column:
    """The API's address that a page names in its head; null if none."""
    found = F.regexp_extract(html, r'<link[^>]*rel="EditURI"[^>]*href="([^"?]+)', 1)
    return F.when(found != "", F.when(found.startswith("//"), F.concat(F.lit("https:"), found)).otherwise(found))


def progress(outcomes: DataFrame, total: int, seconds: float) -> DataFrame:
    """(done, per_second, seconds_left) of a run so far."""
    n = outcomes.agg(F.count("*").alias("done"))
    rate = F.col("done") / F.lit(float(seconds))
    return n.select("done", rate.alias("per_second"), F.when(F.col("done") > 0, (total - F.col("done")) / rate).alias("seconds_left"))
