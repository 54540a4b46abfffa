"""Dry runs: source, contents, policy, a function, outcomes and a report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.operators.pageset import key


def covers(names: Column, bot: str) -> Column:
    """Whether a comma-separated list names the bot or all."""
    return F.exists(F.split(F.lower(names), ","), lambda x: F.trim(x).isin("all", bot.lower()))


def policy(templates: DataFrame, bot: str, task: str | None = None) -> DataFrame:
    """(page_id, denied): the first reason, in order, by which a page's templates keep the bot away.

    templates: page_id, pos, name and params (map) of the pages' bots and nobots templates. A bare
    nobots denies; then a deny list that names the bot; then an allow list that doesn't; then an
    opt-out of all, or of the bot's task.
    """
    name = F.lower(F.trim("name"))
    value = lambda k: F.try_element_at("params", F.lit(k))
    deny, allow, optout = value("deny"), value("allow"), value("optout")
    out = F.exists(F.split(F.lower(optout), ","), lambda x: F.trim(x).isin("all", *([task.lower()] if task else [])))
    said = lambda k, v: F.concat(F.lit("{{"), name, F.lit(f"|{k}="), v, F.lit("}}"))
    reason = (
        F.when((name == "nobots") & deny.isNull() & allow.isNull(), F.lit("{{nobots}}"))
        .when(deny.isNotNull() & covers(deny, bot), said("deny", deny))
        .when(allow.isNotNull() & ~covers(allow, bot), said("allow", allow))
        .when(optout.isNotNull() & out, said("optout", optout))
    )
    hits = templates.where(name.isin("bots", "nobots")).withColumn("denied", reason).where("denied is not null")
    return hits.groupBy("page_id").agg(F.min(F.struct("pos", "denied"))["denied"].alias("denied"))


def dry_run(
    source: DataFrame,
    contents: DataFrame,
    transform: Callable[[pd.DataFrame], pd.DataFrame] | Column,
    finished: DataFrame | None = None,
    pins: DataFrame | None = None,
    denied: DataFrame | None = None,
    limit: int | None = None,
    create_missing: Column | None = None,
) -> DataFrame:
    """(key, outcome, reason, new_text) of every page of the source.

    transform is a column with the new text (null: no edit), or a function from batches of (ns, title,
    text) to a frame with columns new_text and skip_reason. Outcomes: missing, skipped, unchanged,
    pending; a failing function fails the job. pins: (revision_id) of revisions that were seen and
    left as they are. Pages that are finished take no part; a limit takes the first ones by key.
    create_missing gives absent pages a text.
    """
    names = key(source)
    rows = source.join(finished.select(*names), names, "left_anti") if finished is not None else source
    rows = rows.orderBy(*names).limit(limit) if limit is not None else rows
    have = contents.select(*names, "text", *[c for c in ("revision_id", "page_id") if c in contents.columns and c not in rows.columns], F.lit(True).alias("_there"))
    rows = rows.join(have, names, "left")
    rows = rows.join(denied.select("page_id", "denied"), "page_id", "left") if denied is not None else rows.withColumn("denied", F.lit(None).cast("string"))
    if pins is not None:
        rows = rows.join(pins.select("revision_id", F.lit(True).alias("_pinned")).distinct(), "revision_id", "left")
    else:
        rows = rows.withColumn("_pinned", F.lit(None).cast("boolean"))
    if isinstance(transform, Column):
        rows = rows.withColumn("new_text", transform).withColumn("skip_reason", F.lit(None).cast("string"))
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = transform(batch)
                yield batch.assign(new_text=made["new_text"].to_numpy(), skip_reason=made["skip_reason"].to_numpy())

        rows = rows.mapInPandas(run, f"{schema}, new_text string, skip_reason string")
    made = create_missing if create_missing is not None else F.lit(None).cast("string")
    there = F.col("_there").isNotNull()
    outcome = (
        F.when(~there & made.isNull(), "missing").when(~there, "pending").when(F.col("_pinned"), "unchanged").when(F.col("denied").isNotNull(), "skipped")
        .when(F.col("skip_reason").isNotNull() | F.col("new_text").isNull(), "skipped").when(F.col("new_text") == F.col("text"), "unchanged").otherwise("pending")
    )
    reason = F.when(F.col("outcome") == "skipped", F.coalesce("denied", "skip_reason", F.lit("no change needed")))
    return rows.withColumn("outcome", outcome).withColumn("reason", reason).withColumn("new_text", F.when(F.col("outcome") == "pending", F.when(there, F.col("new_text")).otherwise(made))).select(*names, "outcome", "reason", "new_text")


PROBLEMS = 100


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counters: missing pages count as skipped, too; at most 100 problems are listed, by title.

    The list is a top-k report: the first of each partition are kept before they meet.
    """
    n = lambda *kinds: F.coalesce(F.sum(F.col("outcome").isin(*kinds).cast("long")), F.lit(0))
    counts = outcomes.agg(
        n("missing", "skipped", "unchanged", "pending", "failed").alias("processed"), n("pending").alias("pending"), n("unchanged").alias("unchanged"),
        n("skipped", "missing").alias("skipped"), n("missing").alias("missing"), n("failed").alias("failed"),
    )
    listed = outcomes.where("outcome in ('failed', 'missing')").orderBy("title").limit(PROBLEMS).agg(F.sort_array(F.collect_list("title")).alias("problems"))
    out = counts.withColumn("problems", listed.scalar())
    bad = F.col("failed") + F.col("missing")
    return out.withColumn("clean", F.col("failed") == 0).withColumn("problems_truncated", bad > PROBLEMS)


def save_state(outcomes: DataFrame, path: str) -> None:
    """Append finished pages, for a later run's finished."""
    outcomes.where("outcome != 'failed'").drop("new_text").write.mode("append").json(path)


def write_log(outcomes: DataFrame, path: str) -> None:
    """One folder for each outcome."""
    outcomes.write.mode("append").partitionBy("outcome").json(path)
