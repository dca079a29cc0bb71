import base64
import hashlib

import public_tokenizers as public
import pytest
import tiktoken
from compare import DATA

from tidewatch.llm import bpe

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        tokens = bpe.read_ranks(f.read())
    return bpe.Codec(bpe.serialise(tokens), tokens, public.PATTERN)


TEXTS = ["", " ", "\n\n\n", "Hello world", "  two  spaces ", "naïve café", "東京 😀👩‍👩‍👧", "\x00\x01\x02", "▁▁ a▁b", "<|endoftext|> <unk> <s>", "x" * 5000, "ab" * 3000, "!?" * 900, "'s 't 're don't", "1234567890" * 20, "  ﻿", "a\tb\r\nc", "Ġ Ċ Ā"]


@pytest.mark.parametrize("text", TEXTS)
def test_like_tiktoken(codec, plain, text):
    ids = codec.encode(text)
    assert ids == plain.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_byte_has_a_letter():
    assert len(set(bpe.byte_letters())) == 256


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError):
        bpe.read_ranks(b"YQ== 0\nYg== 2\n")


def test_whole_table(spark, plain):
    d = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = bpe.op9(d).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = plain.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, clashing, nothing):
    rows = bpe.op9(odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd.count()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, empty, empty) for r in rows if r["doc_id"] in (3, 4))
    assert bpe.op9(nothing).count() == 0
    got = bpe.decode(bpe.encode(clashing, PATH, public.PATTERN), PATH, public.PATTERN)
    for r in got.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["size"] == "kept size"
