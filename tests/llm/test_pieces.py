import hashlib
import random

import public_tokenizers as public
import pytest
from compare import DATA
from hypothesis import given, settings, strategies as st

from tidewatch.llm import pieces

PATH = public.path("piece_bpe_32k.model")
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return pieces.Pieces(f.read())


TEXTS = ["", " ", "\n\n", "Hello world", "  two  spaces ", " " * 1001, "naïve café", "東京 😀👩‍👩‍👧", "\x00\x01", "▁", "▁▁ a▁b", "<s></s><unk><0x41> ⁇ ", "x" * 5000, "ab" * 3000, "!?" * 900, "1234567890" * 20, "  ﻿", "a\tb\r\nc", "é" * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(codec, text):
    ids = codec.sp.encode(text, add_eos=True)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == codec.sp.decode(ids)


def test_strings_of_pieces(codec):
    """Pieces side by side, where greedy longest matches go wrong most."""
    pick = random.Random(5)
    for _ in range(1500):
        text = "".join(pick.choice([pick.choice(codec.names), pick.choice(codec.names).replace("▁", " "), chr(pick.randrange(32, 0x3000))]) for _ in range(pick.randrange(1, 25)))
        assert codec.encode(text) == codec.sp.encode(text, add_eos=True), text


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    if not hasattr(test_any_text, "codec"):
        with open(PATH, "rb") as f:
            test_any_text.codec = pieces.Pieces(f.read())
    codec = test_any_text.codec
    ids = codec.sp.encode(text)
    assert codec.encode(text, end=False) == ids and codec.decode(ids) == codec.sp.decode(ids)


def test_any_ids(codec):
    """Broken UTF-8 in byte pieces, control ids, several spaces in front."""
    pick = random.Random(6)
    for _ in range(5000):
        ids = [pick.choice([pick.randrange(codec.size), pick.randrange(300), 259, 28705]) for _ in range(pick.randrange(12))]
        assert codec.decode(ids) == codec.sp.decode(ids), ids


def test_steps_back(codec):
    """Some texts need a shorter token than the longest, or a step back."""
    pick, differ = random.Random(7), 0
    for _ in range(300):
        text = "".join(pick.choice("aeinorst") for _ in range(30))
        at, greedy = 0, []
        while at < len(text):
            end = next(e for e in range(min(len(text), at + 16), at, -1) if text[at:e] in codec.score)
            greedy.append(text[at:end])
            at = end
        got = [codec.names[i] for i in codec.run(text)]
        assert got == codec.merged(text)
        differ += got != greedy
    assert differ > 100


def test_sections(codec, monkeypatch):
    monkeypatch.setattr(pieces, "SECTION", 50)
    text = "".join(f"word{i}   and. more\n {'x' * (i % 90)} 東京" for i in range(300))
    ids = codec.sp.encode(text, add_eos=True)
    assert len(list(codec.sections(text))) > 50
    assert codec.encode(text) == ids
    assert codec.digests(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.sp.decode(ids).encode()).hexdigest())


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 10)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    text = " ".join(f"some{i} words{i % 7}" for i in range(200))
    assert codec.encode(text) == codec.sp.encode(text, add_eos=True)
    assert len(codec.known) <= 10 and len(codec.pairs) <= 10


def test_whole_table(spark, codec):
    d = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = pieces.op11(d).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = codec.sp.encode(text[r["doc_id"]], add_eos=True)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.sp.decode(ids).encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_odd_rows(odd, clashing, nothing, codec):
    rows = pieces.op11(odd).collect()
    assert len(rows) == odd.count()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (1, hashlib.sha256(b"2").hexdigest(), EMPTY) for r in rows if r["doc_id"] in (3, 4))
    assert pieces.op11(clashing).count() == len(rows) and pieces.op11(nothing).count() == 0
    got = pieces.decode(pieces.encode(clashing, PATH), PATH)
    for r in got.collect():
        assert r["decoded"] == codec.sp.decode(codec.sp.encode(r["text"] or "")) and r["size"] == "kept size"


def test_only_bpe(spark, odd, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(PATH, "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    assert sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    with pytest.raises(ValueError):
        pieces.encode(odd, str(tmp_path / "unigram.model"))
