"""Page-set algebra: DataFrame to DataFrame, for use with df.transform.

A page is keyed by (wiki, ns, title); frames without a wiki column are keyed by (ns, title). An empty
set of namespaces means all. Patterns are searched for, not matched in full. strict adds the
fragment and page id to the key where a frame has them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

Transform = Callable[[DataFrame], DataFrame]


def key(df: DataFrame, strict: bool = False) -> list[str]:
    wanted = ["wiki", "ns", "title", *(["fragment", "page_id"] if strict else [])]
    return [c for c in wanted if c in df.columns]


def in_namespaces(namespaces: Iterable[int]) -> Transform:
    own = sorted(set(namespaces))
    return lambda df: df.where(F.col("ns").isin(own)) if own else df


def title_matching(pattern: str, negate: bool = False) -> Transform:
    hit = F.col("title").rlike(pattern)
    return lambda df: df.where(~hit if negate else hit)


def text_matching(pattern: str, negate: bool = False) -> Transform:
    hit = F.col("text").rlike(pattern)
    return lambda df: df.where(~hit if negate else hit)


def distinct_pages(pos: str | None = None, strict: bool = False) -> Transform:
    """One row for each page: the first by pos, or any where no order is given (no sort is needed then).

    The first is found by a partial aggregate, so a page that a third of the rows name is no hot task.
    """

    def run(df: DataFrame) -> DataFrame:
        names = key(df, strict)
        if pos is None:
            return df.dropDuplicates(names)
        rest = [c for c in df.columns if c not in names and c != pos]
        firsts = df.groupBy(*names).agg(F.min(F.struct(pos, *rest)).alias("_first"))
        return firsts.select(*names, "_first.*").select(*df.columns)

    return run


def subpage_depth_at_most(n: int) -> Transform:
    """Counts every slash, also where it marks no subpage."""
    return lambda df: df.where(F.length("title") - F.length(F.replace("title", F.lit("/"), F.lit(""))) <= n)


def intersect(other: DataFrame, strict: bool = False) -> Transform:
    """Bag semi-join: duplicates on the left survive. Spark broadcasts the right side where it is small."""
    return lambda df: df.join(other.select(*key(df, strict)), key(df, strict), "left_semi")


def excluding(other: DataFrame, strict: bool = False) -> Transform:
    return lambda df: df.join(other.select(*key(df, strict)), key(df, strict), "left_anti")


def redirects(keep: bool = True) -> Transform:
    return lambda df: df.where(F.col("is_redirect") == keep)


def with_content(contents: DataFrame) -> Transform:
    """Inner join by title: absent pages drop out, empty text stays. Redirects are not followed."""

    def run(df: DataFrame) -> DataFrame:
        names = key(df)
        extra = [c for c in contents.columns if c in names or c not in df.columns]
        return df.join(contents.select(*extra), names)

    return run


def concat(*sources: DataFrame) -> DataFrame:
    """Bag union; the column source_no keeps the order of the sources."""
    parts = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def limited_to(n: int | None, *order: str | Column) -> Transform:
    return lambda df: (df.orderBy(*order) if order else df) if n is None else (df.orderBy(*order) if order else df).limit(n)


#: Rows a range that the bounds of chunked() are found on.
SAMPLE = 20


def chunked(size: int, order: str) -> Transform:
    """A chunk number for rows in order; the last chunk may be short.

    Ties are ordered by a hash of the row. Ranks are made in two steps, rows in each range of the order
    and then the ranges' counts, so that no task sorts all rows. The ranges' bounds are found once, on a
    sample of SAMPLE rows a range, and are constants from then on: they balance the tasks, and every row
    has one range whatever they are. Null comes first.
    """
    if size < 1:
        raise ValueError("size must be positive")

    def run(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        range_, in_, start_ = (n + "_" * sum(c.lower().startswith(n) for c in df.columns) for n in ("range_no", "in_range", "range_start"))
        hashed = [c.name for c in df.schema if not isinstance(c.dataType, MapType | VariantType)]
        key = F.struct(F.col(order).alias("o"), F.xxhash64(*hashed).alias("t"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        total = df.count()
        share = min(1.0, SAMPLE * parts / total) if total else 1.0
        found = df.select(key.alias("k")).sample(share, seed=1).sort("k").limit(2 * SAMPLE * parts).collect()
        kind = df.select(key.alias("k")).schema["k"].dataType
        cuts = [found[len(found) * i // parts]["k"] for i in range(1, parts)] if len(found) > parts else []
        bounds = F.array(*[F.struct(F.lit(c["o"]).cast(kind["o"].dataType).alias("o"), F.lit(c["t"]).alias("t")) for c in cuts])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
        taken = lambda n, s: F.when((n + s <= len(cuts)) & (F.get(bounds, n + s - 1) <= key), n + s).otherwise(n)
        at = F.aggregate(steps, F.lit(0), taken) if cuts else F.lit(0)  # bounds up to the key, by halving
        ranged = df.withColumn(range_, at)
        inside = F.row_number().over(Window.partitionBy(range_).orderBy(key)) - 1
        counts = ranged.groupBy(range_).count()
        before = F.coalesce(F.sum("count").over(Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select(range_, before.alias(start_))
        out = ranged.withColumn(in_, inside).join(starts, range_)
        return out.withColumn("chunk", F.floor((F.col(start_) + F.col(in_)) / size).cast("long")).drop(range_, in_, start_)

    return run
