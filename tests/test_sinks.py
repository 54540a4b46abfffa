"""A stream that is killed between its steps and resumed writes each batch once."""

import pytest

from pagelode.streaming import sinks

SCHEMA = "id long, kind string"


def test_killed_and_resumed(spark, tmp_path, monkeypatch):
    source, path, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).selectExpr("id", "cast(id % 3 as string) as kind").coalesce(1).write.mode("append").parquet(source)

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return sinks.to_ledger(stream, path, "a", state).trigger(availableNow=True).start()

    real, calls = sinks.write_batch, []

    def dies(rows, batch, *rest):
        calls.append(batch)
        if len(calls) == 2:  # before the ledger's row, with half of the batch written
            rows.limit(3).write.mode("overwrite").parquet(f"{path}/rows/run=a/batch={batch}")
            raise RuntimeError("killed early")
        out = real(rows, batch, *rest)
        if len(calls) == 4:  # after the ledger's row, before the stream has noted the batch
            raise RuntimeError("killed late")
        return out

    monkeypatch.setattr(sinks, "write_batch", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination()
        assert sinks.read(spark, path, SCHEMA).count() % 10 == 0  # whole batches only
    start().awaitTermination()
    assert calls == [0, 1, 1, 2, 2, 3]
    got = sinks.read(spark, path, SCHEMA)
    assert sorted(r.id for r in got.collect()) == list(range(40)) and got.select("batch").distinct().count() == 4
    assert sinks.read(spark, path, SCHEMA, "b").count() == 0
    start().awaitTermination()  # nothing new
    assert sinks.read(spark, path, SCHEMA, "a").count() == 40


def test_a_batch_comes_again(spark, tmp_path):
    rows = spark.range(5).selectExpr("id", "'x' as kind")
    assert sinks.read(spark, f"{tmp_path}/o", SCHEMA).count() == 0
    assert sinks.write_batch(rows, 7, f"{tmp_path}/o", "r") and not sinks.write_batch(rows, 7, f"{tmp_path}/o", "r")
    assert sinks.write_batch(rows, 7, f"{tmp_path}/o", "s") and sinks.write_batch(rows.limit(0), 8, f"{tmp_path}/o", "r")
    assert sinks.read(spark, f"{tmp_path}/o", SCHEMA).count() == 10
