"""Words of event data in hex: addresses natively, 256-bit integers exactly."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .keccak import keccak256

# The signatures of the events that are read, by kind of pool.
CREATED = {"v2": "PairCreated(address,address,address,uint256)", "v3": "PoolCreated(address,address,uint24,int24,address)"}
SWAPPED = {"v2": "Swap(address,uint256,uint256,uint256,uint256,address)", "v3": "Swap(address,address,int256,int256,uint160,uint128,int24)"}


@cache
def event_topic(signature: str) -> str:
    """First topic of an event's logs."""
    return "0x" + keccak256(signature.encode()).hex()


def word(data: Column, i: int) -> Column:
    """The i-th 32-byte word of 0x data; null where the data is shorter."""
    return F.when(F.length(data) >= 2 + 64 * (i + 1), F.substring(data, 3 + 64 * i, 64))


def address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


@pandas_udf(StringType())
def _unsigned(words: pd.Series) -> pd.Series:
    return words.map(lambda w: str(int(w, 16)), na_action="ignore")


@pandas_udf(StringType())
def _signed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: str(int(w, 16) - (int(w[0], 16) >> 3 << 256)), na_action="ignore")


def unsigned(data: Column, i: int) -> Column:
    return _unsigned(word(data, i))


def signed(data: Column, i: int) -> Column:
    """Two's complement of 256 bits."""
    return _signed(word(data, i))


def swap_amounts(kind: Column, data: Column) -> tuple[Column, Column]:
    """Signed amounts of a swap's two tokens, from the pool's side: in minus out
    for reserves pools (four unsigned words), as they stand for price pools. A
    kind that isn't known fails the job."""
    from .wide import difference

    reserves, price = kind == "v2", kind == "v3"
    bad = F.raise_error(F.concat(F.lit("unknown swap kind "), F.coalesce(kind, F.lit("null")))).cast("string")
    of = lambda i: F.when(reserves, difference(unsigned(data, i), unsigned(data, i + 2))).when(price, signed(data, i)).otherwise(bad)
    return of(0), of(1)


def refuse(*message) -> Column:
    """Fails the job at a row that reaches it."""
    parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
    return F.raise_error(F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def of_kind(kind: Column, topics: Column, data: Column, signatures: dict[str, str], n_topics: dict[str, int], n_words: dict[str, int]) -> Column:
    """True where a log is a known kind's event, whole; any other fails the job:
    logs of a watched address are never left out."""
    whole = F.lit(False)
    for k, signature in signatures.items():
        right = (F.get(topics, 0) == event_topic(signature)) & (F.size(topics) == n_topics[k]) & (F.length(data) >= 2 + 64 * n_words[k])
        whole = whole | ((kind == k) & right)
    return F.when(F.coalesce(whole, F.lit(False)), True).otherwise(refuse("not an event of a ", kind, " pool: ", F.get(topics, 0)).cast("boolean"))


def small_signed(words: Column, bits: int) -> Column:
    """A whole number of up to 32 bits from the end of a 32-byte word."""
    x = F.conv(F.right(words, F.lit(bits // 4)), 16, 10).cast("bigint")
    return F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x).cast("int")


def created_pool(kind: Column, topics: Column, data: Column) -> Column:
    """(pool, token0, token1, fee, spacing) of a pool-creation log: two tokens in
    the topics; of reserves pools the address in the first word, of price pools
    the fee in a topic, the spacing of ticks and the address in the data."""
    good = of_kind(kind, topics, data, CREATED, {"v2": 3, "v3": 4}, {"v2": 2, "v3": 2})
    price = kind == "v3"
    return F.when(
        good,
        F.struct(
            address(F.when(price, word(data, 1)).otherwise(word(data, 0))).alias("pool"),
            address(F.get(topics, 1)).alias("token0"),
            address(F.get(topics, 2)).alias("token1"),
            F.when(price, F.conv(F.right(F.get(topics, 3), F.lit(6)), 16, 10).cast("int")).alias("fee"),
            F.when(price, small_signed(word(data, 0), 24)).alias("spacing"),
        ),
    )


def swap(kind: Column, topics: Column, data: Column) -> Column:
    """(sender, recipient, amount0, amount1) of a swap log; amounts as from
    swap_amounts."""
    good = of_kind(kind, topics, data, SWAPPED, {"v2": 3, "v3": 3}, {"v2": 4, "v3": 5})
    a0, a1 = swap_amounts(kind, data)
    return F.when(good, F.struct(address(F.get(topics, 1)).alias("sender"), address(F.get(topics, 2)).alias("recipient"), a0.alias("amount0"), a1.alias("amount1")))
