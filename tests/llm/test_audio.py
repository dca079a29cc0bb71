import hashlib
import zlib

import pytest

from tidewatch.llm import audio


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 191, b"y" * 192, b"z" * 193, bytes(range(256)) * 40, b"\xff\xfb\x90\x64" * 300])
def test_round_trip(data):
    p = audio.pad(data)
    assert len(p) % 192 == 0 and len(p) > 0 and p[: len(data)] == data and not p[len(data) :].strip(b" ")
    stored = audio.write_stream(p)
    s = audio.read_stream(stored)
    assert audio.payload_of(stored, s) == p
    assert s.bad_crc == 0 and s.skipped == 0 and not s.cut
    assert s.table["frames"] == len(s.offsets) and s.duration() == (1152 * len(s.offsets), 48000)
    assert all(audio.read_header(stored, x) for x in s.offsets)


def test_resync_after_junk_and_bad_checksum():
    stored = bytearray(audio.write_stream(audio.pad(b"q" * 5000)))
    s = audio.read_stream(bytes(stored))
    mid = s.offsets[2]
    broken = bytes(stored[:mid]) + b"\xff\xe0junk\xff" + bytes(stored[mid:])
    again = audio.read_stream(broken)
    assert len(again.offsets) == len(s.offsets) and again.skipped == 7
    stored[s.offsets[1] + 8] ^= 1
    assert audio.read_stream(bytes(stored)).bad_crc == 1


def test_cut_and_malformed_streams():
    stored = audio.write_stream(audio.pad(b"q" * 5000))
    s = audio.read_stream(stored[:-10])
    assert s.cut and len(s.offsets) == len(audio.read_stream(stored).offsets) - 1
    for data in (b"", b"ID3", b"ID3\x04\0\0\x7f\x7f\x7f\x7f", b"\xff" * 50, stored[:37]):
        assert audio.read_stream(data).samples >= 0


def test_known_checksum():
    assert audio.crc16(b"123456789") == 0xAEE7


def test_odd_rows(odd, clashing, nothing):
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = audio.op4(odd).collect()
    assert len(rows) == odd.count()
    same: dict = {}
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = (text[r["doc_id"]] or "").encode()
        p = audio.pad(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:])
        assert same.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    got = audio.read_media(audio.encode_media(clashing))
    assert got.count() == len(rows) and all(r["size"] == "kept size" for r in got.collect())
    assert audio.op4(nothing).count() == 0


def walk(data, at):
    """Frames one by one from their headers alone, for 48 kHz MPEG-1 Layer III."""
    rates = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    out = []
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4], "big")
        assert head >> 21 == 0x7FF and head >> 19 & 3 == 3 and head >> 17 & 3 == 1 and head >> 10 & 3 == 1
        out.append(at)
        at += 144 * rates[head >> 12 & 15] * 1000 // 48000 + (head >> 9 & 1)
    assert at == len(data)
    return out


@pytest.mark.parametrize("n", [0, 1, 900, 937, 938, 5_000, 400_000])
def test_offsets_by_walking_the_frames(n):
    stored = audio.write_stream(audio.pad(bytes(i * 31 % 251 for i in range(n))))
    s = audio.read_stream(stored)
    begin = 10 + audio._tag_size(stored, 0)
    frames = walk(stored, begin)
    assert s.start == frames[0] and s.offsets == frames[1:]
    assert s.table_agrees() and s.table["bytes"] == len(stored) - begin
    for i, at in enumerate(s.offsets):
        assert s.seek(1152 * i) == s.seek(1152 * i + 1151) == at
    assert s.seek(1152 * len(s.offsets)) == -1


def test_a_table_that_lies():
    stored = audio.write_stream(audio.pad(b"q" * 50_000))
    at = stored.index(b"Xing")
    for place in (at + 11, at + 15, at + 16 + 50):
        wrong = bytearray(stored)
        wrong[place] ^= 0x40
        s = audio.read_stream(bytes(wrong))
        assert not s.table_agrees() and audio.payload_of(bytes(wrong), s) == audio.pad(b"q" * 50_000)
    wrong = bytearray(stored)
    wrong[at - 1] ^= 1  # side information of the table's frame
    assert audio.read_stream(bytes(wrong)).bad_crc == 1


def test_vbri_seek_table():
    stored = audio.write_stream(audio.pad(b"q" * 9_000))
    s = audio.read_stream(stored)
    frames = [stored[a:b] for a, (_, b) in zip(s.offsets, s.frames)]
    head = audio.HEADS[9]
    per, scale = 2, 1
    sizes = [sum(map(len, frames[i : i + per])) for i in range(0, len(frames), per)]
    size = 3 * audio.RATES_1[9]
    body = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (size + sum(map(len, frames))).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + len(sizes).to_bytes(2, "big") + scale.to_bytes(2, "big") + (2).to_bytes(2, "big") + per.to_bytes(2, "big") + b"".join(x.to_bytes(2, "big") for x in sizes)
    first = head[:4] + head[4:] + bytes(36 - len(head)) + body
    data = first + bytes(size - len(first)) + b"".join(frames)
    got = audio.read_stream(data)
    assert got.table["kind"] == "VBRI" and got.table["entries"] == sizes and got.table_agrees() and len(got.offsets) == len(frames)
    broken = bytearray(data)
    broken[36 + 26] ^= 0x10
    assert not audio.read_stream(bytes(broken)).table_agrees()


@pytest.mark.parametrize("note, want", [(b"x", b""), (b"-5", b""), (b"1_0", b""), (b"5", b"qqqqq"), (b"", b"")])
def test_payload_tags(note, want):
    stored = audio.write_stream(b"q" * 192)
    assert audio.payload_of(stored, audio.read_stream(stored)) == b"q" * 192
    s = audio.read_stream(stored)
    s.tags["TXXX:payload_bytes"] = note.decode()
    assert audio.payload_of(stored, s) == want
    del s.tags["TXXX:payload_bytes"]
    assert audio.payload_of(stored, s) == b""


def test_read_media_takes_anything(spark):
    d = spark.createDataFrame([(1, bytearray(b"ID3\x04\0\0\0\0\0\x7fTXXX\0\0\0\x12\0\0\x03payload_bytes\0abc")), (2, None), (3, bytearray(b""))], "id int, media binary")
    assert [r["payload_bytes"] for r in audio.read_media(d).orderBy("id").collect()] == [0, 0, 0]
