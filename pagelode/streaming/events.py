"""Live events: decoding, dedup and windows, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EVENT = """wiki string, type string, title string, namespace int, user string, comment string, timestamp long, bot boolean, minor boolean,
    revision struct<old:long, new:long>, meta struct<domain:string, dt:string>"""


def decode(raw: DataFrame, payload: str = "payload", offset: str = "offset") -> DataFrame:
    """Events from JSON: without a title they go; wiki falls back to the domain, the time to meta.dt; fields of a wrong shape are null."""
    e = raw.select(F.col(offset).alias("offset"), F.from_json(payload, _EVENT).alias("e")).where("e.title is not null")
    return e.select(
        "offset", F.coalesce("e.wiki", "e.meta.domain").alias("wiki"), F.col("e.type").alias("type"), F.col("e.title").alias("title"), F.col("e.namespace").alias("ns"), F.col("e.user").alias("user"),
        F.coalesce(F.timestamp_seconds("e.timestamp"), F.try_to_timestamp("e.meta.dt")).alias("ts"), F.coalesce("e.bot", F.lit(False)).alias("is_bot"),
        F.coalesce("e.minor", F.lit(False)).alias("is_minor"), F.col("e.revision.old").alias("old_rev_id"), F.col("e.revision.new").alias("rev_id"),
    )


def matching(events: DataFrame, wiki: str | None = None, namespaces: Iterable[int] = ()) -> DataFrame:
    own = sorted(set(namespaces))
    events = events.where(F.col("wiki") == wiki) if wiki else events
    return events.where(F.col("ns").isin(own)) if own else events


def once(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once: delivery is at least once, and repeats come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def first_ever(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, however late its repeats come: the state holds all keys, spread over the partitions by key."""
    return events.dropDuplicates(keys)


def counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, by: Iterable[str] = (), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows, with late events up to the watermark."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def repeating(polled: DataFrame, key: str, remember: int = 5000) -> DataFrame:
    """Keys that aren't among the last ones remembered, first in first out; a repeat keeps its place.

    The bound is a count over all keys, so the state has one group: for page lists that are polled, not
    for whole event streams, where once() or first_ever() is the way.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = dict.fromkeys(state.get[0] if state.exists else [])
        out = []
        for batch in batches:
            for k in batch[key]:
                if k not in kept:
                    kept[k] = None
                    out.append(k)
                    if len(kept) > remember:
                        del kept[next(iter(kept))]
        state.update((list(kept),))
        yield pd.DataFrame({key: out})

    return polled.select(key, F.lit(0).alias("all")).groupBy("all").applyInPandasWithState(run, f"{key} string", "kept array<string>", "append", "NoTimeout")
