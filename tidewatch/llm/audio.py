"""Media columns: MPEG-1 Layer III streams, written and read frame by frame."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, small_batches

#: Fixed values of the format (ISO/IEC 11172-3): bit rates in kbit/s by header
#: index for MPEG-1 Layer III and for MPEG-2 Layer III, and sample rates.
RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
BLOCK = 192


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    """The format's checksum: x^16 + x^15 + x^2 + 1, most significant bit first."""
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    """What the four bytes of a Layer III frame header say."""

    size: int
    samples: int
    hertz: int
    kbps: int
    guarded: bool
    side: int
    kind: tuple


def read_header(data: bytes, at: int) -> Header | None:
    """The header at `at`, None if there is none or its values are reserved."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    rate, hertz = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or rate in (0, 15) or hertz == 3:
        return None
    kbps = (RATES_1 if version == 3 else RATES_2)[rate]
    hz = HERTZ[version][hertz]
    samples = 1152 if version == 3 else 576
    mono = data[at + 3] >> 6 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(samples // 8 * kbps * 1000 // hz + (data[at + 2] >> 1 & 1), samples, hz, kbps, not data[at + 1] & 1, side, (version, hertz, mono))


@dataclass
class Stream:
    """What a stream holds. offsets: of each audio frame, in bytes from the
    stream's start; frames: where each one's main data begins and where it ends;
    start: where the first frame begins, the table's if there is one. skipped:
    bytes that belong to no frame or tag."""

    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)
    frames: list = field(default_factory=list)
    start: int = -1
    each: int = 0
    samples: int = 0
    hertz: int = 0
    bad_crc: int = 0
    skipped: int = 0
    cut: bool = False

    def duration(self) -> tuple[int, int]:
        """Exact, as samples and samples a second."""
        return self.samples, self.hertz

    def seek(self, sample: int) -> int:
        """Offset of the frame that holds a sample (all frames of a version have
        the same number of samples); -1 beyond the end."""
        i = sample // self.each if self.each else -1
        return self.offsets[i] if 0 <= i < len(self.offsets) else -1

    def table_agrees(self) -> bool:
        """Whether a variable-bit-rate table is there and says what the frames
        say: their number, the bytes from the table's frame to the last one's
        end, and each seek point, to within its own unit and one frame."""
        t, n = self.table, len(self.offsets)
        if not t or not n or t.get("frames", n) != n:
            return False
        total = self.frames[-1][1] - self.start
        if t.get("bytes", total) != total:
            return False
        most = max(b - a for a, (_, b) in zip(self.offsets, self.frames))
        if "toc" in t:
            return all(abs(x * total / 256 - (self.offsets[n * i // 100] - self.start)) <= total / 256 + most for i, x in enumerate(t["toc"]))
        reach, unit = self.offsets[0], t.get("scale", 1) + most
        for i, x in enumerate(t.get("entries", ())):
            reach += x
            k = (i + 1) * t["frames_per_entry"]
            if abs(reach - (self.offsets[k] if k < n else self.frames[-1][1])) > unit * (i + 1):
                return False
        return True


def _tag_size(data: bytes, at: int) -> int:
    a, b, c, d = data[at + 6 : at + 10]
    return a << 21 | b << 14 | c << 7 | d


def read_tags(data: bytes) -> tuple[dict, int]:
    """ID3v2.3/2.4 text and user-text frames at the start, and where audio may
    begin. A tag that is cut off or malformed gives what it has."""
    at, out = 0, {}
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        major, end = data[at + 3], at + 10 + _tag_size(data, at)
        p = at + 10
        while p + 10 <= min(end, len(data)) and data[p : p + 4].strip(b"\0"):
            name = data[p : p + 4].decode("latin-1")
            n = _tag_size(data, p - 2) if major >= 4 else int.from_bytes(data[p + 4 : p + 8], "big")
            body = data[p + 10 : min(end, p + 10 + n)]
            if name.startswith("T") and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[1:].decode(coding, "replace")
                if name == "TXXX":
                    key, _, value = text.partition("\0")
                    out[f"TXXX:{key}"] = value.rstrip("\0")
                else:
                    out[name] = text.rstrip("\0")
            p += 10 + n
        at = end
    return out, at


def _variable_rate_table(data: bytes, at: int, h: Header) -> dict:
    """A Xing/Info or VBRI table in the frame at `at`, {} if it has none."""
    p = at + 4 + (2 if h.guarded else 0) + h.side
    plain = at + 4 + h.side
    for q in (p, plain):
        if data[q : q + 4] in (b"Xing", b"Info") and q + 8 <= len(data):
            flags, q0, out = int.from_bytes(data[q + 4 : q + 8], "big"), q + 8, {"kind": data[q : q + 4].decode()}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit and q0 + n <= len(data):
                    out[name] = list(data[q0 : q0 + n]) if name == "toc" else int.from_bytes(data[q0 : q0 + n], "big")
                    q0 += n
            return out
    v = at + 36
    if data[v : v + 4] == b"VBRI" and v + 26 <= len(data):
        size, frames, count, scale, width, per_entry = struct.unpack(">IIHHHH", data[v + 10 : v + 26])
        out = {"kind": "VBRI", "bytes": size, "frames": frames, "scale": scale, "frames_per_entry": per_entry}
        if 1 <= width <= 4 and v + 26 + count * width <= at + h.size:
            out["entries"] = [scale * int.from_bytes(data[q : q + width], "big") for q in range(v + 26, v + 26 + count * width, width)]
        return out
    return {}


def read_stream(data: bytes) -> Stream:
    """Reads tags, then frames. A header counts where the next one follows it
    with the same version, sample rate and channels, or the data ends (up to an
    ID3v1 tag); elsewhere the reader moves on byte by byte to the next sync. The
    first frame may be a table of a variable bit rate; it holds no audio, but
    its checksum counts like others. Never raises on malformed data."""
    s = Stream()
    s.tags, at = read_tags(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        s.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    synced, first = False, True
    while at < end:
        h = read_header(data, at)
        ok = h is not None and at + h.size <= end
        if ok and not synced:
            after = read_header(data, at + h.size)
            ok = at + h.size == end or after is not None and after.kind == h.kind
        if not ok:
            if h is not None and at + h.size > end and synced:
                s.cut = True
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.skipped += nxt - at
            at = nxt
            continue
        synced = True
        body = at + 4
        if h.guarded:
            body += 2
            s.bad_crc += crc16(data[at + 2 : at + 4] + data[body : body + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first:
            first = False
            s.start = at
            if table := _variable_rate_table(data, at, h):
                s.table = table
                at += h.size
                continue
        s.offsets.append(at)
        s.frames.append((body + h.side, at + h.size))
        s.samples += h.samples
        s.each = h.samples
        s.hertz = h.hertz
        at += h.size
    return s


# ---- Writing: MPEG-1 Layer III, 48 kHz, one channel, guarded by checksums. A
# frame of b kbit/s has 3 b bytes: header 4, checksum 2, side information 17 (all
# zero: silence, no main data), and the rest holds payload as ancillary data.
OVERHEAD = 4 + 2 + 17
SIDE = bytes(17)


def _head(rate: int) -> bytes:
    head = bytes((0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:] + SIDE).to_bytes(2, "big") + SIDE


HEADS = [b""] + [_head(i) for i in range(1, 15)]
ROOM = [0] + [3 * r - OVERHEAD for r in RATES_1[1:]]


def write_stream(payload: bytes) -> bytes:
    """A stream that holds the payload: an ID3v2.4 tag with its length, a Xing
    table (frames, bytes, 100 seek points) and frames of 320 kbit/s, the last of
    the least rate that has room."""
    full = ROOM[-1]
    frames = [HEADS[-1] + payload[i : i + full] for i in range(0, len(payload) - len(payload) % full, full)]
    rest = payload[len(payload) - len(payload) % full :] if len(payload) % full else b""
    if rest or not frames:
        rate = next(i for i in range(1, 15) if ROOM[i] >= len(rest))
        frames.append(HEADS[rate] + rest + bytes(ROOM[rate] - len(rest)))
    note = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    n = len(note)
    entry = b"TXXX" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + b"\0\0" + note
    m = len(entry)
    tag = b"ID3\x04\0\0" + bytes((m >> 21 & 127, m >> 14 & 127, m >> 7 & 127, m & 127)) + entry
    rate = next(i for i in range(1, 15) if ROOM[i] >= 116)
    size = 3 * RATES_1[rate]
    total = size + sum(map(len, frames))
    each = len(frames[0])
    toc = bytes(min(255, 256 * (size + each * (len(frames) * i // 100)) // total) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return b"".join((tag, HEADS[rate], table, bytes(ROOM[rate] - len(table)), *frames))


def pad(data: bytes) -> bytes:
    return data + b" " * (BLOCK - len(data) if not data else -len(data) % BLOCK)


def payload_of(data: bytes, s: Stream) -> bytes:
    """The frames' data up to the length in the payload's tag, or to its end.
    Nothing where there is no such tag or it isn't a number in plain digits."""
    n = s.tags.get("TXXX:payload_bytes", "")
    return b"".join(data[a:b] for a, b in s.frames)[: int(n)] if n.isascii() and n.isdigit() and len(n) < 20 else b""


def encode_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs without `text`, with a binary column: its UTF-8 bytes (null: none),
    padded with spaces to a positive multiple of 192, as an audio stream; and
    n_bytes, the length before. Columns of these names are replaced."""
    docs = docs.drop(*[c for c in (out, "n_bytes") if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            raw = [t or b"" for t in as_bytes(batch.column(text))]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array([write_stream(pad(t)) for t in raw], pa.binary()), pa.array([len(t) for t in raw], pa.int64())], names=[*[n for n, _ in rest], out, "n_bytes"])

    return docs.mapInArrow(run, docs.drop(text).withColumns({out: F.lit(b""), "n_bytes": F.lit(0).cast("long")}).schema)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df without `media`, with what the stored bytes say: their length and
    digest, the payload's length, digest and the CRC-32 of its last 16 bytes;
    frames, samples and sample rate (the exact duration), frames with a wrong
    checksum, bytes skipped, whether the table agrees with the frames (see
    Stream.table_agrees), and the frames' offsets, which are exact seek points.
    Null media counts as empty; malformed data gives what can
    be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, media):
            rows = []
            for data in as_bytes(batch.column(media)):
                data = data or b""
                s = read_stream(data)
                p = payload_of(data, s)
                agrees = s.table_agrees()
                feature = f"frames={len(s.offsets)};samples={s.samples};hertz={s.hertz};bad_crc={s.bad_crc};skipped={s.skipped};table={'ok' if agrees else 'no'};last_offset={s.offsets[-1] if s.offsets else -1}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(s.offsets), s.samples, s.hertz, s.bad_crc, s.skipped, agrees, s.offsets, feature))
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != media]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], *arrays], names=[*[n for n, _ in rest], *NAMES])

    plain = df.drop(media, *NAMES) if set(NAMES) & set(df.columns) else df.drop(media)
    kept = df.select(*plain.columns, media)
    schema = plain.withColumns({n: F.lit(None).cast(k) for n, k in zip(NAMES, SQL_KINDS)}).schema
    return kept.mapInArrow(run, schema)


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "samples", "hertz", "bad_crc", "skipped_bytes", "table_agrees", "offsets", "feature")
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.string())
SQL_KINDS = ("long", "string", "long", "long", "string", "long", "long", "long", "long", "long", "boolean", "array<long>", "string")


def op4(docs: DataFrame) -> DataFrame:
    got = read_media(encode_media(docs.select("doc_id", "text")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "samples", "hertz", "bad_crc", "table_agrees", "offsets")
