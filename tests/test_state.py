"""State by key: what is emitted, also after a restart in the middle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import state


@pytest.fixture
def keyed(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    state.keyed_state(spark)
    yield spark
    if was is not None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def run(stream, sink, checkpoint, mode, spark):
    """Runs over what is there; rows go to a folder of each batch."""
    write = lambda rows, k: rows.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{sink}/b{checkpoint.rsplit('/')[-1]}-{k}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


TRANSFERS = "id long, ts timestamp, token long, src long, dst long, value long"


def test_balances_reach_zero(keyed, tmp_path):
    put = lambda *rows: keyed.createDataFrame(rows, "id long, at long, token long, src long, dst long, value long").select("id", F.timestamp_seconds("at").alias("ts"), "token", "src", "dst", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: state.holder_balances(keyed.readStream.schema(TRANSFERS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "1 hour")
    put((1, 100, 1, 10, 20, 5), (1, 100, 1, 10, 20, 5), (2, 101, 1, 10, 30, 2))
    run(read(), f"{tmp_path}/out", f"{tmp_path}/c", "update", keyed)
    put((3, 102, 1, 20, 30, 5), (2, 101, 1, 10, 30, 2))
    put((4, 103, 2, 30, 20, 9))
    run(read(), f"{tmp_path}/out", f"{tmp_path}/c", "update", keyed)
    rows = keyed.read.parquet(f"{tmp_path}/out/*").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["batch"]):
        last[r["token"], r["holder"]] = r["balance"]
    assert last == {(1, 10): -7, (1, 20): 0, (1, 30): 7, (2, 30): -9, (2, 20): 9}


SWAPS = "ts timestamp, pool long, buyer long, side string, amount long"


def windows(rows, width, every, passed):
    out = {}
    for pool in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == pool]
        t = -(-min(r[0] for r in mine) // every) * every
        while t <= passed:
            inside = [r for r in mine if t - width <= r[0] <= t]
            before = [r for r in mine if t - every - width <= r[0] <= t - every]
            if inside or before:
                buys, sells = [r for r in inside if r[3] == "BUY"], [r for r in inside if r[3] == "SELL"]
                out[pool, t] = (len({r[2] for r in buys if r[2] is not None}), len(buys), len(sells), sum(r[4] for r in buys), sum(r[4] for r in sells))
            t += every
    return out


def test_windows_decay(keyed, tmp_path):
    rows = [(5, 1, 7, "BUY", 10), (17, 1, 7, "BUY", 1), (17, 1, 8, "SELL", 4), (40, 1, None, "BUY", 2), (61, 2, 9, "BUY", 3), (200, 3, 1, "SELL", 1), (230, 1, 5, "BUY", 6), (500, 9, 1, "BUY", 1)]
    put = lambda some: keyed.createDataFrame(some, "at long, pool long, buyer long, side string, amount long").select(F.timestamp_seconds("at").alias("ts"), "pool", "buyer", "side", "amount").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: state.decaying_windows(keyed.readStream.schema(SWAPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "10 seconds", 30, 20)
    for part in (rows[:4], rows[4:6]):
        put(part)
        run(read(), f"{tmp_path}/out", f"{tmp_path}/c", "append", keyed)
    put(rows[6:])
    run(read(), f"{tmp_path}/out", f"{tmp_path}/c", "append", keyed)
    got = {}
    for r in keyed.read.parquet(f"{tmp_path}/out/*").withColumn("at", F.unix_seconds("t")).collect():
        assert (r["pool"], r["at"]) not in got
        got[r["pool"], r["at"]] = (r["buyers"], r["buys"], r["sells"], r["buy_volume"], r["sell_volume"])
    assert got == windows(rows, 30, 20, 490)


def test_every_is_at_most_width():
    with pytest.raises(ValueError):
        state.Windows(10, 20)
