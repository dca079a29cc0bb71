"""Keccak-256 of short texts: selectors of signatures, checksummed addresses.

Selectors are a small table made once on the driver; checksums are an Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MASK, LANES = (1 << 64) - 1, 25


def _turn(x: int, n: int) -> int:
    n %= 64
    return (x << n | x >> 64 - n) & MASK if n else x


def _round_constants() -> list[int]:
    """From the linear feedback register of the standard."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << (1 << j) - 1
            r = (r << 1) ^ (0x171 if r >> 7 else 0)
        out.append(c)
    return out


ROUNDS = _round_constants()


def _permute(a: list[int]) -> list[int]:
    for constant in ROUNDS:
        column = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        a = [a[i] ^ column[(i % 5 - 1) % 5] ^ _turn(column[(i % 5 + 1) % 5], 1) for i in range(LANES)]
        x, y, moved = 1, 0, a[1]
        b = list(a)
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            moved, b[x + 5 * y] = a[x + 5 * y], _turn(moved, (t + 1) * (t + 2) // 2)
        a = [b[i] ^ ~b[i - i % 5 + (i + 1) % 5] & b[i - i % 5 + (i + 2) % 5] & MASK for i in range(LANES)]
        a[0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    rate = 136
    data += b"\x01" + bytes(-(len(data) + 1) % rate)
    data = data[:-1] + bytes([data[-1] | 0x80])
    a = [0] * LANES
    for at in range(0, len(data), rate):
        for i in range(rate // 8):
            a[i] ^= int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")
        a = _permute(a)
    return b"".join(x.to_bytes(8, "little") for x in a[:4])


def keccak256_many(data: list[bytes]) -> list[bytes]:
    """The digests of many texts: those of as many blocks are permuted together,
    a lane an array of theirs."""
    rate, groups, out = 136, {}, [b""] * len(data)
    for i, d in enumerate(data):
        groups.setdefault(len(d) // rate + 1, []).append(i)
    for blocks, places in groups.items():
        padded = bytearray(b"".join((data[i] + b"\x01").ljust(blocks * rate, b"\0") for i in places))
        words = np.frombuffer(padded, "uint8").reshape(len(places), -1)
        words[:, -1] |= 0x80
        words = words.view("<u8").reshape(len(places), blocks, -1)
        a = [np.zeros(len(places), "uint64")] * LANES
        for k in range(blocks):
            a = _permute([a[i] ^ words[:, k, i] if i < rate // 8 else a[i] for i in range(LANES)])
        digests = np.stack(a[:4], axis=1).astype("<u8").tobytes()
        for n, i in enumerate(places):
            out[i] = digests[32 * n : 32 * n + 32]
    return out


def selector(signature: str) -> str:
    return keccak256(signature.encode()).hex()[:8]


def checksums(addresses: list[str]) -> list[str]:
    """Upper case where the digest's digit is 8 or more."""
    plain = [a.lower().removeprefix("0x") for a in addresses]
    digests = keccak256_many([p.encode() for p in plain])
    return ["0x" + "".join(c.upper() if d >= "8" else c for c, d in zip(p, digest.hex())) for p, digest in zip(plain, digests)]


def checksum(address: str) -> str:
    return checksums([address])[0]


def checksum_address(address: Column) -> Column:
    @pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        known = values.dropna()
        return pd.Series(checksums(known.tolist()), index=known.index, dtype=object).reindex(values.index)

    return run(address)
