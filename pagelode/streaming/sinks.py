"""Sinks of a stream that a restart doesn't write twice.

A batch's rows are a folder of its own, and a ledger keeps one row (run, batch, rows) for each batch that is
whole. A batch that comes again after a failure replaces its folder if the ledger doesn't have it, and
writes nothing if it does. Readers take the batches of the ledger only, so a folder that a lost driver
left half written is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

LEDGER = "run string, batch long, rows long"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none before the first batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger") if there else spark.createDataFrame([], LEDGER)


def write_batch(rows: DataFrame, batch: int, path: str, run: str) -> bool:
    """Write one batch under path unless the ledger has it; whether it was written.

    The ledger's row is a file of its own, put in its place at once when the batch's files are all there.
    """
    spark = rows.sparkSession
    if not _ledger(spark, path).where((F.col("run") == run) & (F.col("batch") == batch)).isEmpty():
        return False
    folder = f"{path}/rows/run={run}/batch={batch}"
    rows.write.mode("overwrite").parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()
    spark.createDataFrame([(run, batch, n)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return True


def to_ledger(stream: DataFrame, path: str, run: str, checkpoint: str) -> DataStreamWriter:
    """The stream's writer: each batch by write_batch. The same checkpoint and run resume it."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path, run) and None).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, path: str, schema: str, run: str | None = None) -> DataFrame:
    """The rows of all whole batches, with run and batch; of one run if it is given."""
    whole = _ledger(spark, path)
    if run is not None:
        whole = whole.where(F.col("run") == run)
    if whole.isEmpty():
        return spark.createDataFrame([], f"{schema}, run string, batch long")
    rows = spark.read.schema(f"{schema}, run string, batch long").parquet(f"{path}/rows")
    return rows.join(whole.select("run", "batch").distinct(), ["run", "batch"], "left_semi")
