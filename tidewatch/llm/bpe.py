"""Byte-level BPE by a sentencepiece model serialised from the vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

#: Distinct pre-tokens that a worker remembers.
MEMORY = 200_000


def byte_letters() -> list[str]:
    """One printable character per byte: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks run from 0 without gaps."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in data.splitlines() if line)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto of type BPE: piece i is token i in byte
    letters with score -i; after them the unknown piece; identity normaliser,
    no prefix, white space as it is."""
    letters = byte_letters()
    pieces = []
    for rank, token in enumerate(tokens):
        text = "".join(letters[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    unknown = _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.known: dict[str, tuple[int, ...]] = {}

    def pre_token(self, piece: str) -> tuple[int, ...]:
        return tuple(self.sp.encode(piece.encode().decode("latin-1").translate(self.letters)))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, more = self.known, ids.extend
        for piece in self.find(text):
            got = known.get(piece)
            if got is None:
                got = self.pre_token(piece)
                if len(known) >= MEMORY:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = got
            more(got)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(shared: Broadcast) -> Codec:
    tokens, model, pattern = shared.value
    return Codec(model, tokens, pattern)


def _share(df: DataFrame, vocabulary: str, pattern: str) -> Broadcast:
    """The vocabulary file is the same size whatever the corpus, about 1 MB."""
    with open(vocabulary, "rb") as f:
        tokens = read_ranks(f.read())
    return df.sparkSession.sparkContext.broadcast((tokens, serialise(tokens), pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs and an array<int> column of token ids; null text has none. Matches
    of the pattern are encoded each by itself; there are no special tokens. A
    column named as `out` is replaced."""
    shared = _share(docs, vocabulary, pattern)
    docs = docs.drop(out) if out != text else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches, text):
            ids = [codec.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.array().cast("array<int>")).schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and a binary column, the bytes of the ids; null ids give no bytes. An
    id outside the vocabulary fails the job. A column named as `out` is replaced."""
    shared = _share(df, vocabulary, pattern)
    df = df.drop(out) if out != ids else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches, ids, 1 << 20):
            got = [codec.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(b"")).schema)


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, the digest of the ids in decimal with single
    spaces, the digest of the bytes that the ids decode to. Encodes and decodes
    within one task, so ids never leave it; null text counts as empty, and
    repeated rows and null keys keep their rows."""
    d = docs.select(F.col(key), F.col(text).alias("text"))
    shared = _share(d, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches, "text"):
            n, first, second = [], [], []
            for t in batch.column("text").to_pylist():
                ids = codec.encode(t or "")
                n.append(len(ids))
                first.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = d.select(key).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    return d.mapInArrow(run, schema)


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    return token_digests(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
