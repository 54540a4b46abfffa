"""What the operators of this subpackage share: words, scratch tables and column names.

A *word* is a run of characters other than U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting to remove an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key of a join with more rows may be dealt over several tasks; so many keys at most, each over so many tasks.
HOT_ROWS, HOT_KEYS, MOST_SALTS = 1000, 1000, 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("pagelode.scratch.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagelode-")
        spark.conf.set("pagelode.scratch.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut the lineage, so that a lost executor costs no recomputation.

    A table's shuffle files are of no use once it is written; Spark is told to remove them at the end of
    the write. clear() deletes the tables of all operators when their results are no longer read.
    """

    roots: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.roots.append(self.root)

    def save(self, df: DataFrame, name: str, compression: str = "lz4", dictionary: bool = True) -> DataFrame:
        """dictionary: whether Parquet tries to number equal values; tables of hashes have none."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this process; results that read them must have been written."""
    while Scratch.roots:
        _delete(spark, Scratch.roots.pop())


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row a key. A key with many rows is dealt over several tasks.

    Keys with more than HOT_ROWS rows, at most the HOT_KEYS largest, are found first; any other key
    then holds less than one in HOT_KEYS of the rows. rows is read twice and should be a saved table,
    unless counts (keys, count) is given. Null keys meet nothing.
    """
    spark = rows.sparkSession
    found = rows.groupBy(*keys).count() if counts is None else counts.select(*keys, "count")
    top = found.where(F.col("count") > HOT_ROWS).orderBy(F.desc("count")).limit(HOT_KEYS).collect()
    if not top:
        return rows.join(table, keys, how)
    schema = StructType([rows.schema[k] for k in keys]).add("salts_", "long")
    hot = F.broadcast(spark.createDataFrame([(*r[:-1], min(MOST_SALTS, r[-1] // HOT_ROWS + 1)) for r in top], schema))
    others = [c for c in rows.columns if c not in keys]
    salts = F.coalesce("salts_", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("salt_", F.pmod(F.xxhash64(*others), salts)).drop("salts_")
    copied = table.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts_")
    return dealt.join(copied, [*keys, "salt_"], how).drop("salt_")


#: Bits of a map of keys.
MAP_BITS = 1 << 24


def _map_places(key: Column) -> tuple[Column, Column]:
    """The word and the bit of a key in a map."""
    spot = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    return F.shiftright(spot, 6).cast("int"), spot.bitwiseAND(F.lit(63)).cast("int")


def bit_map(keys: DataFrame, key: str) -> DataFrame:
    """One row with a map of keys as an array of 64-bit words, of a fixed size; it only keeps rows from a join that would drop them."""
    word, bit = _map_places(F.col(key))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bits = keys.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(MAP_BITS // 64).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    held = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(held, lambda x: x["bits"]).alias("bits"))


def in_map(flags: DataFrame, key: Column) -> Column:
    """Whether a key may be in the map; false means that it isn't."""
    word, bit = _map_places(key)
    return F.call_function("shiftright", F.get(flags.scalar(), word), bit).bitwiseAND(F.lit(1)) == 1


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until they clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The array of a text's words; empty for null or blank text."""
    blank = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(blank, " "), "")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.size(words_of(text)).cast("long")
