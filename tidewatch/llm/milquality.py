"""Quality classifier: attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, join_bounded, small_batches, stash, word_hashes, word_starts
from .langid import held_out

#: Words of a passage.
PASSAGE = 64
#: Bytes beyond which a text is encoded in pieces, of whole passages.
LONG = 4 << 20
#: Classes of bytes whose pairs make most of a passage's encoding.
CLASSES = ((b" \t\v\f", 0), (b"\n\r", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (b".", 5), (b",", 6), (b"!?", 7), (b";:'\"-", 8), (b"()[]{}<>/\\", 9), (b"*&$%#@^~`_=+", 10), (b"|", 11), (bytes(range(0xC0, 0x100)), 12), (bytes(range(0x80, 0xC0)), 13))
CLASS = np.full(256, 14, np.uint8)
for _members, _k in CLASSES:
    CLASS[list(_members)] = _k
KINDS = 15
EXTRA = 5
WIDTH = KINDS * KINDS + EXTRA


def _whole_passages(data: bytes, size: int) -> Iterator[bytes]:
    """A text without white space at its ends in parts of about `size` bytes that
    end, but for the last, where a passage does: right before the first word of
    the next. Each begins with the byte before it, a space for the first."""
    data = b" " + data + b" "
    at = end = 1
    while at < len(data):
        end = max(end, at) + size
        starts = at + word_starts(np.frombuffer(data, np.uint8, min(len(data), end) - at, at))
        # the last word may go on beyond `end`, but its start counts
        whole = (len(starts) - 1) // PASSAGE * PASSAGE
        if end >= len(data):
            yield data[at - 1 :]
            return
        if whole > 0:
            yield data[at - 1 : starts[whole]]
            at = end = int(starts[whole])


def encode_passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, features) of every passage of 64 words of every text. A text
    without words is one passage of zeros. Features: frequencies of pairs of
    byte classes; fullness; mean length of words; words equal to the one before;
    distinct words; a constant for passages that have words. A text longer than
    LONG bytes is encoded in pieces of whole passages, to the same result."""
    stripped = [(t or b"").strip(b" \t\n\v\f\r") for t in texts]
    begins = np.cumsum([1] + [len(t) + 1 for t in stripped])[:-1]
    if len(texts) == 1 and len(stripped[0]) > LONG:
        x = np.concatenate([_encode(p, begins)[1] for p in _whole_passages(stripped[0], LONG // 2)])
        return np.zeros(len(x), np.int64), x
    return _encode(b" " + b" ".join(stripped) + b" ", begins)


def _encode(joined: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """encode_passages of texts that begin at `begins`, one byte apart."""
    n, raw = len(begins), np.frombuffer(joined, np.uint8)
    starts = word_starts(raw)
    if not len(starts):
        return np.arange(n), np.zeros((n, WIDTH), np.float32)
    doc = np.searchsorted(begins, starts, side="right") - 1
    # of empty texts that begin at one place, searchsorted takes the last, which
    # is the one that holds the word
    head = np.concatenate(([True], doc[1:] != doc[:-1]))
    base = np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))
    new = (np.arange(len(doc)) - base) % PASSAGE == 0
    passage = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    count = int(passage[-1]) + 1
    span = starts[first]
    ends = np.append(span[1:], len(raw))
    owner = np.repeat(np.arange(count), ends - span)
    kind = CLASS[raw]
    pair = kind[span[0] - 1 : -1].astype(np.int64) * KINDS + kind[span[0] :]
    x = np.bincount(owner * (KINDS * KINDS) + pair, minlength=count * KINDS * KINDS).reshape(count, -1).astype(np.float32)
    size = (ends - span).astype(np.float32)
    h = word_hashes(raw, starts)
    words = np.diff(np.append(first, len(starts))).astype(np.float32)
    same = np.concatenate(([False], (h[1:] == h[:-1]) & ~new[1:]))
    key = np.lexsort((h, passage))
    fresh = np.concatenate(([True], (h[key][1:] != h[key][:-1]) | (passage[key][1:] != passage[key][:-1])))
    extra = np.stack([words / PASSAGE, size / words / 10, np.add.reduceat(same.astype(np.float32), first) / words, np.bincount(passage[key], fresh, count) / words, np.ones(count)], axis=1)
    x = np.concatenate([x / size[:, None], extra.astype(np.float32)], axis=1)
    own = doc[first]
    empty = np.setdiff1d(np.arange(n), own)
    if len(empty):
        own, x = np.concatenate([own, empty]), np.concatenate([x, np.zeros((len(empty), WIDTH), np.float32)])
        order = np.argsort(own, kind="stable")
        own, x = own[order], x[order]
    return own, x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """mean, scale: of the features; w0, b0: passage encoder; v, u, w: gated
    attention; c, b: the bag's score."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """Bags are runs of passages that begin at `starts`."""
        w = self.w
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w["w0"] + w["b0"])
        t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (t * g) @ w["w"]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner, "p": _sigmoid(z @ w["c"] + w["b"])}


def gradient(model: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray, xs: np.ndarray | None = None) -> dict:
    """Of the mean cross-entropy of the bags' labels, by weight. xs: the scaled
    features, where they are at hand."""
    w = model.w
    xs = np.clip((x - model.mean) / model.scale, -8, 8) if xs is None else xs
    f = model.forward(x, starts)
    h, t, g, a, owner = f["h"], f["t"], f["g"], f["a"], f["owner"]
    dl = ((f["p"] - y) / len(y)).astype(x.dtype)
    dz = dl[:, None] * w["c"]
    da = (h * dz[owner]).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[owner])
    dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[owner] + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
    return {"w0": xs.T @ dh, "b0": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ dl, "b": dl.sum(keepdims=True)}


def fit(x: np.ndarray, starts: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 250, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the cross-entropy of the documents' labels; every step takes all
    bags. Without both labels the model says the share of label 1."""
    rng = np.random.default_rng(7)
    d = x.shape[1] if len(x) else WIDTH
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"w0": init(d, hidden), "b0": np.zeros(hidden, np.float32), "v": init(hidden, gate), "u": init(hidden, gate), "w": init(gate), "c": init(hidden), "b": np.zeros(1, np.float32)}
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w["b"][0] = np.log(share / (1 - share))
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
    model = Model(mean.astype(np.float32), scale.astype(np.float32), w)
    if not len(y) or y.min() == y.max():
        w["c"][:] = 0
        return model
    m, s = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    xs = np.clip((x - model.mean) / model.scale, -8, 8)
    for step in range(1, rounds + 1):
        grad = gradient(model, x, starts, y, xs)
        for k in w:
            gk = grad[k] + decay * w[k] * (k != "b")
            m[k] = 0.9 * m[k] + 0.1 * gk
            s[k] = 0.999 * s[k] + 0.001 * gk * gk
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 3000, most_bytes: int = 64 << 20) -> Model:
    """Learns from all passages of documents with a label. `most` and
    `most_bytes` bound the sample of labelled rows: with more rows or bytes of
    text, each row is taken with the probability that brings their expected
    number to the bound, by a hash of its id. Repeated labels of an id count
    once, the greater."""
    l = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    l = stash(l, "quality-labels")
    n = l.count()
    taken = lambda rate: F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.lit(rate * (1 << 20))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rate = most / max(n, most)
    size = join_bounded(texts.where(taken(rate)), l.where(taken(rate)), "id").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rate *= most_bytes / max(size, most_bytes)
    d = join_bounded(texts.where(taken(rate)), l.where(taken(rate)), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            own, x = encode_passages(as_bytes(batch.column("text")))
            ends = np.searchsorted(own, np.arange(batch.num_rows + 1))
            got = [x[a:b].astype(np.float16).tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(got, pa.binary())], names=["id", "label", "x"])

    rows = d.mapInArrow(run, d.select("id", "label").withColumn("x", F.lit(b"")).schema).toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in rows.column("x").to_pylist()]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, WIDTH), np.float32)
    starts = np.cumsum([0] + [len(b) for b in bags])[:-1]
    return fit(x, starts, (rows.column("label").to_numpy() > 0).astype(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without `text`, with score (0 to 1), predicted (1 if score >= 0.5)
    and n_passages. Null and wordless texts are one empty passage and get a
    score too. Every passage of a text counts; rows are judged one by one, so
    there is no shuffle. Columns of these names are replaced."""
    names = ("score", "predicted", "n_passages")
    kept = [c for c in docs.columns if c not in (text, *names)]
    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            own, x = encode_passages(as_bytes(batch.column("text")))
            starts = np.searchsorted(own, np.arange(batch.num_rows))
            p = shared.value.forward(x, starts)["p"].astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.diff(np.append(starts, len(own))))], names=[*kept, *names])

    return d.mapInArrow(run, d.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "n_passages": F.lit(0).cast("long")}).schema)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = held_out(F.col("doc_id"), 3, 1, False)
    model = train(docs, labels.where(~out))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted", "n_passages")
