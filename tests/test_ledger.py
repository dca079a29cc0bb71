"""Batches that are whole or not there at all, folders that stay few."""

from __future__ import annotations

import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidewatch.streaming import ingest, ledger as ledgers, passes, queries
from tidewatch.streaming.ledger import Conflict, Ledger, due


class Cut(Exception):
    """What ends a batch in the middle."""


@pytest.fixture
def cut_after(monkeypatch):
    """After n writes of folders the next one fails, in its middle or at its
    end; the manifest is the write after the last folder."""
    left = {"n": None}
    plain = ledgers.Batch.write

    def write(self, df, path):
        if left["n"] == 0:
            left["n"] = None
            plain(self, df.limit(1), path)
            raise Cut
        if left["n"] is not None:
            left["n"] -= 1
        plain(self, df, path)

    monkeypatch.setattr(ledgers.Batch, "write", write)
    return lambda n: left.update(n=n)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def put(ledger, df, *run):
    batch = ledger.begin(*run)
    if batch is None:
        return None
    new = batch.append_once("t", df, ["k"], ["k"]).count()
    batch.append("copies", df)
    batch.advance("c", processed=df.agg(F.max("k")).first()[0])
    batch.commit()
    return new


def test_batches(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.table("t") is None and ledger.cursor("c") is None
    assert put(ledger, rows(spark, (1, "x"), (2, "y"), (2, "z")), "r", 0) == 2
    assert put(ledger, rows(spark, (2, "new"), (3, "z")), "r", 1) == 1
    assert put(ledger, rows(spark, (2, "new"), (3, "z")), "r", 1) is None
    assert put(ledger, rows(spark, (1, "x"), (2, "y")), "other", 0) == 0
    assert sorted(map(tuple, ledger.table("t").collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert ledger.cursor("c") == 3


def test_null_keys_never_collide(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    for k in range(2):
        batch = ledger.begin("r", k)
        batch.append_once("t", rows(spark, (None, "a"), (None, "a"), (1, "b")), ["k"])
        batch.commit()
    assert sorted(map(str, ledger.table("t").collect())).count("Row(k=None, v='a')") == 4 and ledger.table("t").count() == 5


def test_cursors_only_move_forward(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    for observed, processed in ((9, 5), (4, 7)):
        batch = ledger.begin()
        batch.advance("c", observed=observed, processed=processed)
        batch.commit()
    assert (ledger.cursor("c", "observed"), ledger.cursor("c")) == (9, 7)


def test_one_writer(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    a, b = ledger.begin(), ledger.begin()
    a.advance("c", processed=1)
    a.commit()
    b.advance("c", processed=2)
    with pytest.raises(Conflict):
        b.commit()
    assert ledger.cursor("c") == 1


@pytest.mark.parametrize("n", range(4))
def test_cut_anywhere(spark, tmp_path, cut_after, n):
    """Whatever write a batch fails at, nothing of it is seen, and it comes
    whole by the same run again or by another."""
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    put(ledger, rows(spark, (1, "x")), "r", 0)
    cut_after(n)
    if n < 3:
        with pytest.raises(Cut):
            put(ledger, rows(spark, (1, "q"), (2, "y")), "r", 1)
        assert [r["k"] for r in ledger.table("t").collect()] == [1] and ledger.table("copies").count() == 1 and ledger.cursor("c") == 1
        assert put(ledger, rows(spark, (1, "q"), (2, "y")), *(("r", 1) if n % 2 else ("fresh", 0))) == 1
    else:
        assert put(ledger, rows(spark, (1, "q"), (2, "y")), "r", 1) == 1
    assert sorted(r["k"] for r in ledger.table("t").collect()) == [1, 2] and ledger.table("copies").count() == 3 and ledger.cursor("c") == 2


def test_a_manifest_cut_in_the_middle(spark, tmp_path, monkeypatch):
    """The slot that is written is emptied first; the other holds the state."""
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    for k in range(3):
        put(ledger, rows(spark, (k, "x")), "r", k)
    for f in (tmp_path / "l/manifest/slot=0").glob("*.parquet"):
        f.unlink()
    assert ledger.state()["seq"] == 3
    put(ledger, rows(spark, (3, "x")), "r", 3)
    assert ledger.table("t").count() == 4


def test_folders_stay_few():
    """Over 2,000 batches: at most fanout - 1 folders a level after merging."""
    folders, most = [], 0
    for k in range(2000):
        folders.append({"level": 0, "rows": 1})
        while old := due(folders, 8):
            folders = [f for f in folders if not any(f is o for o in old)] + [{"level": old[0]["level"] + 1, "rows": sum(f["rows"] for f in old)}]
        most = max(most, len(folders))
    assert most <= 28 and sum(f["rows"] for f in folders) == 2000


def test_batches_read_few_folders(spark, tmp_path):
    """Merged folders keep all rows; a batch of new keys reads no folder, one of
    old keys those that hold them."""
    ledger = Ledger(spark, f"file://{tmp_path}/l", fanout=3)
    for k in range(13):
        batch = ledger.begin("r", k)
        batch.append_once("t", spark.range(k * 50, k * 50 + 50).select(F.xxhash64("id").alias("k")), ["k"])
        assert batch.read == []
        batch.commit()
    state = ledger.state()["tables"]["t"]
    assert len(state["folders"]) <= 6 and sum(f["rows"] for f in state["folders"]) == 650
    batch = ledger.begin("r", 13)
    assert batch.append_once("t", spark.range(600, 660).select(F.xxhash64("id").alias("k")), ["k"]).count() == 10
    assert len(batch.read) == 1
    batch.commit()
    assert ledger.table("t").distinct().count() == ledger.table("t").count() == 660


def test_filters_have_no_false_negatives(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    batch = ledger.begin()
    batch.append_once("t", spark.range(3000).select(F.col("id").cast("string").alias("k")), ["k"])
    batch.commit()
    t = ledger.state()["tables"]["t"]
    one = ledger.begin()
    for k in ("0", "17", "2999"):
        assert len(one.holding("t", t, spark.createDataFrame([(k,)], "k string"))) == 1
    hits = sum(bool(one.holding("t", t, spark.createDataFrame([(f"absent{i}",)], "k string"))) for i in range(5))
    assert hits == 0


def test_ranges_leave_folders_out(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    for k in range(4):
        put(ledger, rows(spark, (10 * k, "a"), (10 * k + 9, "b")), "r", k)
    assert sorted(r["k"] for r in ledger.table("t", since=("k", 19)).collect()) == [19, 20, 29, 30, 39]
    assert "folder" not in ledger.table("t").columns


def test_folds(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l", fanout=2, folds={"deltas": ingest.net})
    for k in range(4):
        batch = ledger.begin("r", k)
        batch.append("deltas", spark.createDataFrame([(1, 7, 5), (1, k, 1)], "token long, holder long, delta long"))
        batch.commit()
    d = ledger.table("deltas")
    assert d.count() == 5 and {r["holder"]: r["delta"] for r in d.collect()}[7] == 20


# ---- streams and passes


def test_streams_that_are_cut(spark, tmp_path, cut_after):
    """A stream that fails between two tables, begun again from its own
    checkpoint and from a fresh one: every transfer counts once."""
    d = spark.createDataFrame([(i, 1, i % 3, 3 + i % 2, 10) for i in range(40)], "id long, token long, src long, dst long, value long")
    d.repartition(4).write.parquet(f"{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    run = lambda c: ingest.net_balances(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), out, f"{tmp_path}/{c}").awaitTermination()
    for n, checkpoint in ((1, "a"), (2, "a"), (2, "b")):
        cut_after(n)
        with pytest.raises(Exception):
            run(checkpoint)
    cut_after(None)
    run("b")
    run("c")
    ledger = ingest.transfers_ledger(spark, out)
    assert ledger.table("transfers").count() == 40
    want = {}
    for i in range(40):
        want[i % 3] = want.get(i % 3, 0) - 10
        want[3 + i % 2] = want.get(3 + i % 2, 0) + 10
    assert {r["holder"]: r["balance"] for r in ingest.balances(spark, out).collect()} == want


A, B = (f["address"] for f in queries.FACTORIES)
WORD = lambda x: f"{x % (1 << 256):064x}"
ADDRESS = lambda x: f"0x{x:040x}"
QUOTE = ADDRESS(1)
LOGS = "block long, log_index long, tx string, address string, topics array<string>, data string"


def created(block, pool, kind="v2", token0=1, token1=50, index=0):
    topics = [passes.abi.event_topic(passes.abi.CREATED[kind]), "0x" + WORD(token0), "0x" + WORD(token1)]
    if kind == "v3":
        return (block, index, f"c{block}-{index}", B, [*topics, "0x" + WORD(3000)], "0x" + WORD(-60) + WORD(pool))
    return (block, index, f"c{block}-{index}", A.upper().replace("0X", "0x"), topics, "0x" + WORD(pool) + WORD(9))


def swapped(block, pool, a0, a1, kind="v2", to=77, index=0):
    topics = [passes.abi.event_topic(passes.abi.SWAPPED[kind]), "0x" + WORD(5), "0x" + WORD(to)]
    amounts = [a0, a1, 1, 1, 1] if kind == "v3" else [max(a0, 0), max(a1, 0), max(-a0, 0), max(-a1, 0)]
    return (block, index, f"s{block}-{index}", ADDRESS(pool), topics, "0x" + "".join(map(WORD, amounts)))


def source(spark, rows):
    d = spark.createDataFrame(rows, LOGS)

    def logs(first, last, pools=None):
        part = d.where(F.col("block").between(first, last))
        return part if pools is None else part.join(pools.select(F.col("pool").alias("address")), "address", "left_semi").select(d.columns)

    return logs


def discover(spark, ledger, rows, head, **more):
    return passes.discovery_pass(ledger, source(spark, rows), head, queries.FACTORIES, [QUOTE], **{"span": 10, **more})


def test_discovery(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    rows = [created(3, 100), created(3, 100, token1=51, index=1), created(12, 101, "v3", 50, 1), created(14, 102, token0=60, token1=61), created(25, 103)]
    done = discover(spark, ledger, rows, 24, confirmations=2)
    assert (done.first, done.last, done.spans, done.logs, done.inserted) == (0, 22, 3, 4, 3)
    assert (ledger.cursor("discovery"), ledger.cursor("discovery", "observed")) == (22, 24)
    pools = {r["pool"]: r for r in ledger.table("pools").collect()}
    assert set(pools) == {ADDRESS(100), ADDRESS(101), ADDRESS(102)}
    first, price, strange = pools[ADDRESS(100)], pools[ADDRESS(101)], pools[ADDRESS(102)]
    assert (first["kind"], first["token1"], first["quote"], first["base"], first["fee"], first["dex"]) == ("v2", ADDRESS(50), QUOTE, ADDRESS(50), None, "alpha")
    assert (price["fee"], price["spacing"], price["quote"], price["base"]) == (3000, -60, QUOTE, ADDRESS(50))
    assert (strange["quote"], strange["base"]) == (None, None)
    assert discover(spark, ledger, rows, 24, confirmations=2) == passes.Done()
    assert discover(spark, ledger, rows, 30).first == 23 and ledger.table("pools").count() == 4
    assert {r["token"]: r["block"] for r in ledger.table("tokens").collect()}[ADDRESS(50)] == 3


def test_no_factories(spark, tmp_path):
    assert passes.discovery_pass(Ledger(spark, f"file://{tmp_path}/l"), None, 9, [], []) == passes.Done()


@pytest.mark.parametrize("bad", ["address", "topic", "short"])
def test_logs_are_never_left_out(spark, tmp_path, bad):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    block, index, tx, address, topics, data = created(3, 100)
    row = {"address": (block, index, tx, ADDRESS(999), topics, data), "topic": (block, index, tx, address, ["0xbad", *topics[1:]], data), "short": (block, index, tx, address, topics, data[:90])}[bad]
    with pytest.raises(Exception, match="unwatched|not an event"):
        discover(spark, ledger, [row], 9)
    assert ledger.cursor("discovery") is None and ledger.table("pools") is None


MIN = 60_000_000


def act(spark, ledger, rows, head, **more):
    return passes.activity_pass(ledger, source(spark, rows), head, lambda block: block * MIN, **{"span": 10, **more})


def test_activity(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    swaps = [swapped(21, 100, 30, -7), swapped(22, 100, 30, -9, to=78), swapped(23, 100, -5, 4, index=1), swapped(31, 100, 12, -1), swapped(24, 101, -8, 20, "v3"), swapped(95, 101, 2, 2, "v3")]
    assert act(spark, ledger, swaps, 40) == passes.Done()
    discover(spark, ledger, [created(20, 100), created(24, 101, "v3", 50, 1), created(24, 102, token0=60, token1=61, index=1)], 100)
    done = act(spark, ledger, swaps, 1000)
    assert (done.first, done.last, done.logs, done.inserted) == (20, 100, 6, 6)
    got = {(r["pool"], r["block"]): r for r in ledger.table("snapshots").collect()}
    assert set(got) == {(ADDRESS(100), 29), (ADDRESS(101), 29), (ADDRESS(100), 39), (ADDRESS(101), 99)}
    a = got[ADDRESS(100), 29]
    assert (a["buyers_20m"], a["buys_20m"], a["sells_20m"], a["buy_volume_20m"], a["sell_volume_20m"], a["repeated_bps"], a["gini_bps"]) == (2, 2, 1, "60", "5", 10000, 0)
    b = got[ADDRESS(100), 39]
    assert (b["buyers_1h"], b["buys_20m"], b["buy_volume_1h"], b["buy_volume_20m"]) == (2, 3, "72", "72")
    c = got[ADDRESS(101), 29]
    assert (c["buys_20m"], c["buy_volume_1h"], c["gini_bps"]) == (1, "20", None)
    d = got[ADDRESS(101), 99]
    assert (d["buys_20m"], d["buyers_1h"], d["buy_volume_1h"], d["repeated_bps"]) == (0, 0, "0", None)
    assert {r["side"] for r in ledger.table("swaps").where("block = 95").collect()} == {"UNKNOWN"}
    # caught up: only windows decay
    assert act(spark, ledger, swaps, 1000, active=lambda p: p).refreshed == 1
    assert act(spark, ledger, swaps, 1000, active=lambda p: p).refreshed == 0


def test_wide_amounts(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    wide = (1 << 255) - 1
    discover(spark, ledger, [created(1, 100)], 30)
    act(spark, ledger, [swapped(2, 100, wide, -1), swapped(3, 100, wide, -2, to=78)], 30)
    r = ledger.table("snapshots").first()
    assert (r["buy_volume_1h"], r["gini_bps"], r["repeated_bps"]) == (str(2 * wide), None, 10000)


@pytest.mark.parametrize("n", [1, 3, 4, 6])
def test_passes_that_are_cut(spark, tmp_path, cut_after, n):
    """Cut at any write of any span, both passes end with the same tables."""
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    creations = [created(3, 100), created(12, 101, "v3")]
    swaps = [swapped(4, 100, 30, -7), swapped(13, 101, -9, 5, "v3")]
    cut_after(n)
    for _ in range(2):
        try:
            discover(spark, ledger, creations, 15)
            act(spark, ledger, swaps, 15)
        except Cut:
            continue
    cut_after(None)
    assert ledger.table("pools").count() == 2 and ledger.table("tokens").count() == 2
    assert ledger.table("swaps").count() == 2 and ledger.table("snapshots").count() == 2
    assert (ledger.cursor("discovery"), ledger.cursor("activity")) == (15, 15)


def test_the_log_source_feeds_a_pass(spark, tmp_path):
    logs = passes.block_logs(spark, "tests.fake_logs:creations", 4)
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    done = passes.discovery_pass(ledger, logs, 19, queries.FACTORIES, [QUOTE], span=10)
    assert (done.spans, done.logs) == (2, 20) and ledger.table("pools").count() == 20


def test_made_logs(spark):
    """The queries' logs are read back to what the tables say."""
    assert queries.discovered_pools(spark, str(DATA / "sf0.001")).count() == spark.read.parquet(f"{DATA}/sf0.001/part.parquet").count()
