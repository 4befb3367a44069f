"""Streams replayed batch by batch from files."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest

from plumbline.streaming import tracks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_what_was_out_of_sight_is_sent_again(rocks, tmp_path):
    pytest.importorskip("google.protobuf")  # Spark's own client of the state store wants it
    spark = rocks
    at = lambda s: datetime.fromtimestamp(s, UTC).replace(tzinfo=None)
    batches = [[("a", 2), ("a", 1), ("b", 1)], [("a", 5), ("b", 30)], [("a", 33), ("c", 33)], [("a", 36), ("a", 50), ("b", 36), (None, 37)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame([(k, at(s)) for k, s in rows], "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = None
    (tmp_path / "flat").mkdir()
    for n in range(len(batches)):
        part = next((tmp_path / "in" / str(n)).glob("part-*"))
        part.rename(tmp_path / "flat" / f"{n}.parquet")
        stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
        found = tracks.first_sight(stream, ["k"], "ts", 10_000, "0 seconds")
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.k, int(r.ts.replace(tzinfo=UTC).timestamp())): r.sent for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("a", 1): True, ("a", 2): False, ("a", 5): False, ("a", 33): True, ("a", 36): False, ("a", 50): True,
        ("b", 1): True, ("b", 30): True, ("b", 36): False, ("c", 33): True, (None, 37): True,
    }
    assert stream is not None
