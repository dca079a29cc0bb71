"""Language identification by mixture inference over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, small_batches

#: Byte trigrams around letters are hashed to so many buckets.
BITS = 15
BUCKETS = 1 << BITS
#: Letters of a byte: a-z, and bytes of characters beyond ASCII. Others are gaps.
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)
#: EM goes on until no share moves by more than this, or for so many rounds.
STILL, ROUNDS = 1e-3, 100
#: Grams of neighbouring letters overlap: so many count as one.
SHARE_OF_GRAMS = 3.0
#: A batch holds so many bytes of text times languages (or 4 MB, if that is less).
BATCH = 64 << 20


def gram_buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, buckets) of the trigrams whose middle byte is a letter's. The
    array must begin and end with a gap."""
    d = LETTER[data]
    at = np.flatnonzero(d[1:-1] != 32) + 1
    code = d[at - 1].astype(np.uint32) << np.uint32(16) | d[at].astype(np.uint32) << np.uint32(8) | d[at + 1]
    return at, (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def bags(texts: list[bytes | None], piece: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket, count) of all texts, sorted by both. One text that is
    longer than `piece` is counted piece by piece."""
    if len(texts) == 1 and len(texts[0] or b"") > piece:
        total = np.zeros(BUCKETS, np.int64)
        raw = np.frombuffer(b" " + texts[0] + b" ", np.uint8)
        for a in range(1, len(raw) - 1, piece):
            part = raw[a - 1 : min(len(raw), a + piece + 1)]
            total += np.bincount(gram_buckets(part)[1], minlength=BUCKETS)
        b = np.flatnonzero(total)
        return np.zeros(len(b), np.int64), b, total[b]
    lengths = np.array([len(t or b"") + 2 for t in texts], np.int64)
    raw = np.frombuffer(b" " + b"  ".join(t or b"" for t in texts) + b" ", np.uint8)
    at, bucket = gram_buckets(raw)
    which = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)[at]
    keys = np.sort(which << np.uint32(BITS) | bucket)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint32(BITS)).astype(np.int64), (keys & np.uint32(BUCKETS - 1)).astype(np.int64), count


@dataclass
class Model:
    """languages, and p[bucket, language]: likelihoods times the bucket count."""

    languages: list[str]
    p: np.ndarray

    def em(self, p: np.ndarray, count: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihood of each document's mixture from the given
        first shares; languages with share 0 stay out. Each document's rounds
        end for itself, so its neighbours in a batch don't count."""
        share = share.astype(np.float32)
        lengths = np.diff(np.append(starts, len(p)))
        open_ = np.arange(len(starts))
        q, c, own = p, count, np.repeat(open_, lengths)
        for _ in range(ROUNDS):
            r = q * share[own]
            r *= (c / np.maximum(r.sum(1), 1e-30))[:, None]
            first = np.concatenate(([0], np.cumsum(lengths[open_])[:-1]))
            s = np.add.reduceat(r, first, axis=0)
            s /= s.sum(1, keepdims=True)
            moved = np.abs(s - share[open_]).max(1) > STILL
            share[open_] = s
            if not moved.any():
                break
            if not moved.all():
                rows = np.repeat(moved, lengths[open_])
                q, c, own, open_ = q[rows], c[rows], own[rows], open_[moved]
        total = np.maximum((p * share[np.repeat(np.arange(len(starts)), lengths)]).sum(1), 1e-30)
        return share, np.add.reduceat(count * np.log(total), starts)

    def infer(self, texts: list[bytes | None]) -> list[tuple[str, float, list[tuple[str, float]], float]]:
        """(language, score, mixture, gain) per text. EM over all languages
        ranks them. Then the sets of the first 1, 2 ... of them are compared, up
        to all: a language must raise the log-likelihood, counted per
        independent gram, by more than its penalty (half the log of the number
        of grams, and 4). No set's likelihood is above that of all languages, so
        sizes that it can't justify aren't tried. score is the best language's
        share of the chosen mixture times the probability of that mixture against
        chance (all grams alike) and, if it is of one language, against the other
        languages alone: near 0 for a script that no learned text has. EM ends
        after ROUNDS where it still moves, with the shares it then has; its
        likelihood only grows, so sets are compared by a lower bound. gain: the
        mixture's log-likelihood, less
        the penalties of languages beyond the first, less that of chance (all
        grams alike), plus one penalty: below 0 only where chance explains the
        text better by more than a language may cost. Ties go to the language
        that comes first."""
        out = [("und", 0.0, [], 0.0)] * len(texts)
        which, bucket, count = bags(texts)
        if not len(which) or not self.languages:
            return out
        first = np.flatnonzero(np.diff(which, prepend=-1))
        docs = which[first]
        owner = np.repeat(np.arange(len(docs)), np.diff(np.append(first, len(which))))
        at = np.arange(len(docs))
        p, c = self.p[bucket], count.astype(np.float32)
        n = np.add.reduceat(c, first)
        alone = np.add.reduceat(c[:, None] * np.log(p), first, axis=0)
        share, full = self.em(p, c, first, np.full((len(docs), len(self.languages)), 1 / len(self.languages)))
        best = alone.argmax(1)
        rank = share + 2.0 * (np.arange(len(self.languages)) == best[:, None])
        order = np.argsort(-rank, axis=1, kind="stable")
        penalty = (0.5 * np.log(n + 1) + 4.0) * SHARE_OF_GRAMS
        chosen, value = np.ones(len(docs), int), alone[at, best]
        final = np.where(np.arange(len(self.languages)) == best[:, None], 1.0, 0.0)
        for k in range(2, len(self.languages) + 1):
            mixed = np.flatnonzero(full - value > penalty * (k - chosen))
            if not len(mixed):
                break
            rows = np.isin(owner, mixed)
            sub_first = np.flatnonzero(np.diff(owner[rows], prepend=-1))
            inside = np.zeros((len(mixed), len(self.languages)))
            np.put_along_axis(inside, order[mixed][:, :k], 1.0 / k, axis=1)
            s, ll = self.em(p[rows], c[rows], sub_first, inside)
            better = ll - value[mixed] > penalty[mixed] * (k - chosen[mixed])
            took = mixed[better]
            chosen[took], value[took], final[took] = k, ll[better], s[better]
        gain = value + penalty * (1 - chosen)
        # log-likelihoods are against chance, whose own is 0
        rivals = np.where((chosen == 1)[:, None], alone, gain[:, None])
        rivals[chosen > 1, 1:] = -np.inf
        told = np.concatenate([np.zeros((len(docs), 1)), rivals], axis=1) / SHARE_OF_GRAMS
        told -= told.max(1, keepdims=True)
        sure = np.exp(np.where(chosen == 1, told[at, 1 + best], told[:, 1])) / np.exp(told).sum(1)
        for j, d in enumerate(docs):
            top = int(final[j].argmax())
            parts = sorted(((self.languages[i], float(final[j, i])) for i in np.flatnonzero(final[j] > 0)), key=lambda x: (-x[1], x[0]))
            out[d] = (self.languages[top], float(min(1.0, max(0.0, final[j, top] * sure[j]))), parts, float(gain[j] + penalty[j]))
        return out


def held_out(key: Column, n: int, r: int, learn_from_r: bool) -> Column:
    """Whether a row is not learned from: crc32 of the id as text, modulo n, is
    r (or is not r). A null id is held out."""
    rest = F.crc32(key.cast("string").cast("binary")) % n
    return F.coalesce(rest != r if learn_from_r else rest == r, F.lit(True))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 3000, smoothing: float = 0.05) -> Model:
    """Learns from the rows of docs with a language. `per_language` bounds the
    sample: of a language with more rows, each is taken with probability
    per_language / rows, by a hash of its id. Whole texts of the sample are
    counted on the executors; the driver gets one number per language and
    bucket.

    Every language is smoothed towards one background, half the mean of all
    languages and half chance, in proportion to its own size: a gram that no text
    of the language has is equally likely in all of them, however few rows a
    language has."""
    d = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rates = d.groupBy("lang").agg((F.lit(float(per_language)) / F.greatest(F.count("*"), F.lit(per_language))).alias("keep"))
    languages = sorted(r["lang"] for r in rates.select("lang").collect())
    # one row a language, as the model has a column for each
    d = d.join(F.broadcast(rates), "lang")
    d = d.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.col("keep") * (1 << 20)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, "text"):
            names = batch.column("lang").to_pylist()
            index = {x: i for i, x in enumerate(sorted(set(names)))}
            code = np.array([index[x] for x in names])
            which, bucket, count = bags(as_bytes(batch.column("text")))
            for x, i in index.items():
                own = code[which] == i
                t = total.setdefault(x, np.zeros(BUCKETS, np.int64))
                t += np.bincount(bucket[own], count[own], BUCKETS).astype(np.int64)
        for x, t in total.items():
            b = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(b), pa.string()), pa.array(b), pa.array(t[b])], names=["lang", "bucket", "n"])

    counts = d.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    p = np.zeros((BUCKETS, len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    p[counts.column("bucket").to_numpy(), [index[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    return Model(languages, smoothed(p, smoothing))


def smoothed(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Likelihoods times the bucket count, from counts by bucket and language; a
    language without grams is the background alone."""
    if not counts.shape[1]:
        return counts.astype(np.float32)
    own = counts / np.maximum(counts.sum(0), 1)
    background = (own.mean(1, keepdims=True) + 1 / BUCKETS) / 2
    background /= background.sum()
    p = own + smoothing * background
    return (p / p.sum(0) * BUCKETS).astype(np.float32)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without `text`, with lang_pred, score, languages (an array of
    struct(lang, share)) and gain (see Model.infer). `und`, 0, an empty array and
    0 where the text is null or has no letter. Whole texts are read; rows are judged one by one, so there is
    no shuffle. The model is as large as languages times buckets. Columns of
    these names are replaced."""
    names = ("lang_pred", "score", "languages", "gain")
    kept = [c for c in docs.columns if c not in (text, *names)]
    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.col(text))).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in small_batches(batches, "text", min(4 << 20, BATCH // max(1, len(shared.value.languages)))):
            got = shared.value.infer(as_bytes(batch.column("text")))
            mixtures = pa.array([[{"lang": x, "share": s} for x, s in g[2]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), mixtures, pa.array([g[3] for g in got], pa.float64())], names=[*kept, *names])

    schema = d.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "languages": F.array().cast("array<struct<lang:string,share:double>>"), "gain": F.lit(0.0)}).schema
    return d.mapInArrow(run, schema)


def fitted(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id"), 5, 0, False)))


def op3(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0, False).alias("held_out"), "text")
    return identify(d, fitted(docs)).select("doc_id", "held_out", "lang_pred", "score", "languages")


def identified_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is undetermined (null text, no
    letter), or whose grams no mixture of languages explains better than chance,
    by the penalised likelihood. A table whose lang is all null teaches no
    language, so nothing can be identified and no row stays. Rows are judged one
    by one: repeated rows and null keys stay as they are."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole__"), "text")
    got = identify(d, fitted(docs)).where((F.col("lang_pred") != "und") & (F.col("gain") >= 0))
    return got.select("whole__.*")
