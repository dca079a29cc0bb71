"""Wilson intervals, quartile splits, quantiles, balances, k-NN, downsampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import spread
from . import ranks
from .series import half_up

Z = 1.96


def r6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % bounds in basis points; null for n <= 0."""
    p, z2 = k / n, Z * Z
    mid, half, den = p + z2 / (2 * n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n), 1 + z2 / n
    low, high = F.greatest(F.lit(0.0), (mid - half) / den), F.least(F.lit(1.0), (mid + half) / den)
    return F.when(n > 0, half_up(low * 10000)), F.when(n > 0, half_up(high * 10000))


def multiple_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of keys: count, quantiles of the multiple, shares of two and
    five times, median fall."""
    share = lambda x: half_up(F.avg((F.col("mult") >= x).cast("int")) * 10000)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("mult").alias("min"), F.max("mult").alias("max"), share(20000).alias("share_2x"), share(50000).alias("share_5x"))
    g = ranks.beside(g, ranks.nearest_ranks(df, keys, "mult", {"median": 0.5, "p75": 0.75}), keys)
    return ranks.beside(g, ranks.nearest_ranks(df, keys, "dd", {"median_dd": 0.5}), keys)


def net_balances(transfers: DataFrame) -> DataFrame:
    """(token, holder, balance) of debits and credits; only what is above zero."""
    out = transfers.select("token", F.col("src").alias("holder"), (-F.col("value")).alias("v")).unionByName(transfers.select("token", F.col("dst").alias("holder"), F.col("value").alias("v")))
    return out.groupBy("token", "holder").agg(F.sum("v").cast("bigint").alias("balance")).where("balance > 0")


def concentration(balances: DataFrame, top: int = 10, excluded: str = "holder % 13 = 0") -> DataFrame:
    """Holders, largest and top-10 shares in basis points, rounded down, of the
    balances that are not excluded."""
    b = balances.withColumn("out", F.expr(excluded))
    w = Window.partitionBy("token", "out").orderBy(F.col("balance").desc(), "holder")
    b = b.withColumn("rank", F.row_number().over(w))
    own = ~F.col("out")
    g = b.groupBy("token").agg(F.count("*").alias("holders"), F.count(F.when(own, 1)).alias("adjusted_holders"), F.sum("balance").alias("supply"), F.sum(F.when(own, F.col("balance"))).alias("base"), F.max(F.when(own, F.col("balance"))).alias("largest"), F.sum(F.when(own & (F.col("rank") <= top), F.col("balance"))).alias("most"))
    return g.select("token", "holders", "adjusted_holders", F.expr("coalesce(largest, 0) * 10000 div coalesce(base, supply)").alias("largest_bps"), F.expr("coalesce(most, 0) * 10000 div coalesce(base, supply)").alias("top10_bps"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A row a list; NaN for nulls, and throughout for lists of another length."""
    good = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False)
    out = np.full((len(lists), width), np.nan)
    out[good] = lists.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _distances(rows: np.ndarray, probes: np.ndarray, shared: bool, scale: float) -> np.ndarray:
    """A row a probe, rounded half up; squares are added in the order of features.
    `shared`: over the features that both have, infinite if they share none."""
    total, none = np.zeros((len(probes), len(rows))), np.full((len(probes), len(rows)), shared)
    for x, y in zip(rows.T, probes.T):
        d = x[None, :] - y[:, None]
        d *= d
        if shared:
            lacks = np.isnan(d)
            d[lacks] = 0.0
            none &= lacks
        total += d
    out = np.floor(np.sqrt(total) * scale + 0.5) / scale
    out[none] = np.inf
    return out


def _nearest(vectors: DataFrame, probes: DataFrame, k: int, most: int, shared: bool, scale: float) -> DataFrame:
    """(probe, id, distance, rank) of vectors and probes (id, v). Each task keeps
    the k nearest of its rows for every probe of a block while it reads them, a
    million distances at a time; only those are shuffled and ranked."""

    def ranked(block: DataFrame) -> DataFrame:
        t = block.select("id", "v").toArrow()
        names, width = t["id"].to_numpy(), max(pc.max(pc.list_value_length(t["v"])).as_py() or 0, 0)
        known = vectors.sparkSession.sparkContext.broadcast((names, _matrix(t["v"].combine_chunks(), width)))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, wanted = known.value
            best = [(np.empty(0, "int64"),) * 2 + (np.empty(0),) for _ in range(0, len(names), 250)]
            for batch in batches:
                ids, m = batch["id"].to_numpy(), _matrix(batch["v"], width)
                for at in range(0, len(ids), 4_000):
                    few = ids[at : at + 4_000]
                    for n, low in enumerate(range(0, len(names), 250)):
                        here = names[low : low + 250]
                        best[n] = _merged(best[n], few, here, _distances(m[at : at + 4_000], wanted[low : low + 250], shared, scale), k)
            for n, (place, id_, distance) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(names[250 * n + place]), pa.array(id_), pa.array(distance)], ["probe", "id", "distance"])

        found = spread(vectors.select("id", "v"), "id").mapInArrow(keep, "probe long, id long, distance double")
        w = Window.partitionBy("probe").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    as_long = lambda df: df.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    vectors = as_long(vectors)
    return in_blocks(as_long(probes), "id", most, ranked)


def _merged(best: tuple, ids: np.ndarray, probes: np.ndarray, d: np.ndarray, k: int) -> tuple:
    """The k nearest by (distance, id) for each of some probes, of `best` (place
    of the probe, id, distance; in order) and of ids at distances d; not itself."""
    place, id_, distance = best
    other = ids[None, :] != probes[:, None]
    d = np.where(other, d, np.nan)
    bar = np.full(len(probes), np.nan)
    full = np.bincount(place, minlength=len(probes)) >= k
    if len(place):
        bar[full] = distance[np.flatnonzero(np.append(place[1:] != place[:-1], True))][full[np.unique(place)]]
    if not full.all() and len(ids) > k:
        bar[~full] = np.partition(d[~full], k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero(other & ((d <= bar[:, None]) | np.isnan(bar)[:, None]))
    place, id_, distance = np.append(place, r), np.append(id_, ids[c]), np.append(distance, d[r, c])
    order = np.lexsort((id_, distance, place))
    place, id_, distance = place[order], id_[order], distance[order]
    first = np.searchsorted(place, place)
    top = np.arange(len(place)) - first < k
    return place[top], id_[top], distance[top]


def knn(vectors: DataFrame, probes: DataFrame, k: int, most: int = 20_000, scale: float = 1e6) -> DataFrame:
    """Of each probe (a stated query set), the k rows nearest by the Euclidean
    distance, rounded to 1 / `scale`; ties by id; itself not. Ids are whole
    numbers. Vectors that lack a value are last. Up to `most` probes are broadcast;
    more go through in blocks of so many."""
    return _nearest(vectors, probes, k, most, False, scale)


def in_blocks(probes: DataFrame, key: str, most: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over blocks of probes of about `most` rows by a hash of their key."""
    n = -(-probes.count() // most) or 1
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return reduce(DataFrame.unionByName, [work(probes.where(block == i) if n > 1 else probes) for i in range(n)])


def downsample(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Of each key, `most` rows evenly spaced in order, first and last kept."""
    w = Window.partitionBy(key)
    d = df.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * (F.col("n") - 1) / (most - 1) + 0.5).cast("bigint"))
    return d.where((F.col("n") <= most) | F.array_contains(wanted, F.col("i").cast("bigint"))).drop("n")


def nearest_shared(rows: DataFrame, probes: DataFrame, features: list[str], k: int, most: int = 20_000) -> DataFrame:
    """Of each probe (a stated query set), the k rows nearest by the Euclidean
    distance over the features that both have; rows that share none are last.
    Probes go through in blocks of `most`, as in knn."""
    as_vector = lambda df: df.select("id", F.array(*features).alias("v"))
    return _nearest(as_vector(rows), as_vector(probes), k, most, True, 1e6)
