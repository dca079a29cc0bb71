"""State by key: balances that reach zero, and windows that decay by themselves.

Both need the RocksDB state store (see `keyed_state`). A restart goes on from
the checkpoint: state, timers and watermark are in it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW = "pool long, t timestamp, buyers long, buys long, sells long, buy_volume long, sell_volume long"


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, for the session's queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def holder_balances(transfers: DataFrame, late: str) -> DataFrame:
    """From a stream of transfers (id, ts, token, src, dst, value): the balance of
    each holder that a batch has moves of, also zero and below, in update mode.
    Repeated ids count once if no more than `late` apart. Spark's own sum keeps
    the balances: it combines before the shuffle and calls no Python a holder."""
    t = transfers.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    side = lambda who, sign: F.struct(F.col(who).alias("holder"), (sign * F.col("value")).alias("delta"))
    moves = t.select("token", F.inline(F.array(side("src", -1), side("dst", 1))))
    return moves.groupBy("token", "holder").agg(F.sum("delta").alias("balance"))


class Windows(StatefulProcessor):
    """A pool's swaps of the last `width`, read at every multiple of `every`
    (seconds both, every <= width). No window begins or ends inside a cell: a
    multiple of their common divisor, or what lies between two of them. State:
    sums by cell, the distinct buyers of a cell as one packed value, the last
    multiple that was read; the first two shrink as time passes, whether or not
    the pool still trades. A timer stands at the next multiple while the window
    holds anything; the first empty one is emitted too, as zeros."""

    def __init__(self, width: int, every: int):
        if not 0 < every <= width:
            raise ValueError("every must be above 0 and at most width")
        self.width, self.every, self.cell = width * 1_000_000, every * 1_000_000, gcd(width, every) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "at long", "buys long, sells long, buy_volume long, sell_volume long")
        self.buyers = handle.getMapState("buyers", "at long", "ids binary")
        self.read = handle.getValueState("read", "at long")

    def _due(self, at: int) -> int:
        """The first multiple at or after `at` that wasn't read yet."""
        due = -(-at // self.every) * self.every
        return max(due, self.read.get()[0] + self.every) if self.read.exists() else due

    def _bought(self, at: int) -> np.ndarray:
        return np.frombuffer(self.buyers.getValue((at,))[0], "int64") if self.buyers.containsKey((at,)) else np.empty(0, "int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[int]] = {}
        buyers: dict[int, np.ndarray] = {}
        for r in rows:
            buy, sell = r["side"].eq("BUY"), r["side"].eq("SELL")
            at = r["ts"].astype("datetime64[us]").astype("int64")
            # what lies between two multiples stands a microsecond after the first
            at = at - at % self.cell + (at % self.cell > 0)
            r = r.assign(at=at, buys=buy.astype("int64"), sells=sell.astype("int64"), buy_volume=r["amount"].where(buy, 0), sell_volume=r["amount"].where(sell, 0))
            for at, *values in r.groupby("at", as_index=False)[["buys", "sells", "buy_volume", "sell_volume"]].sum().itertuples(index=False, name=None):
                sums[int(at)] = [x + int(y) for x, y in zip(sums.get(int(at), (0, 0, 0, 0)), values)]
            for at, ids in r.loc[buy & r["buyer"].notna()].groupby("at")["buyer"]:
                buyers[int(at)] = np.union1d(buyers.get(int(at), np.empty(0, "int64")), ids.to_numpy().astype("int64"))
        for at, values in sums.items():
            was = self.sums.getValue((at,)) if self.sums.containsKey((at,)) else (0, 0, 0, 0)
            self.sums.updateValue((at,), tuple(int(x) + y for x, y in zip(was, values)))
        for at, ids in buyers.items():
            self.buyers.updateValue((at,), (np.union1d(self._bought(at), ids).tobytes(),))
        self.handle.registerTimer(self._due(min(sums)) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.read.exists() and at <= self.read.get()[0]:
            return
        sums = sorted((k[0], v) for k, v in self.sums.iterator())
        times = [t for t, _ in sums]
        out, last, bought = [], at, {}
        while at <= passed:
            low, last = at - self.width, at
            first, end = bisect_left(times, low), bisect_right(times, at)
            bought = {t: bought[t] if t in bought else self._bought(t) for t in times[first:end]}
            inside = [v for _, v in sums[first:end]]
            out.append((key[0], pd.Timestamp(at, unit="us"), len(np.unique(np.concatenate([np.empty(0, "int64"), *bought.values()]))), *(sum(v[i] for v in inside) for i in range(4))))
            if inside:
                at += self.every
            elif end < len(times):
                at = -(-times[end] // self.every) * self.every
            else:
                at = None
                break
        if at is not None:
            self.handle.registerTimer(at // 1000)
        self.read.update((last,))
        for t in times[: bisect_left(times, last - self.width)]:
            self.sums.removeKey((t,))
            if self.buyers.containsKey((t,)):
                self.buyers.removeKey((t,))
        yield pd.DataFrame(out, columns=["pool", "t", "buyers", "buys", "sells", "buy_volume", "sell_volume"])

    def close(self) -> None:
        pass


def decaying_windows(swaps: DataFrame, late: str, width: int, every: int) -> DataFrame:
    """From a stream of swaps (ts, pool, buyer, side, amount): what each pool's
    window [t - width, t] comes to at every multiple t of `every` seconds that the
    watermark has passed, as long as it holds anything, and once more when it
    holds nothing. Swaps later than `late` are dropped."""
    s = swaps.where("side IN ('BUY', 'SELL')").withWatermark("ts", late)
    return s.groupBy("pool").transformWithStateInPandas(Windows(width, every), WINDOW, "append", "eventTime")
