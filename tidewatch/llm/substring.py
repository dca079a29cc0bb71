"""Substring dedup: paragraphs by MinHash banding, and passages inside them."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, as_bytes, discard, join_bounded, mix64, release, small_batches, stash, word_hashes, word_starts
from .components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: Words that a repeated paragraph has at least, unless asked otherwise.
LEAST = 20
#: Of every WINDOW passages of PASSAGE words that begin at consecutive words, the
#: one with the least hash is kept: two texts that share STRETCH words in a row
#: share a kept passage.
PASSAGE, WINDOW = 20, 31
STRETCH = PASSAGE + WINDOW - 1
ROWS = 3
#: Bits for a word of a text in a place that is one number; a text has fewer than
#: 2^30 words, as an array has fewer than 2^31 bytes.
PLACE = 30


def tune_bands(similarity: float = SIMILARITY, recall: float = 0.999, rows: int = ROWS) -> int:
    """Bands of `rows` minima each, so that a pair of the given similarity meets
    in one of them with probability `recall` at least."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of n hash functions."""
    rng = np.random.default_rng(11)
    r = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    return r[:, 0] * np.uint64(2) + np.uint64(1), r[:, 1]


POLY = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xD6E8FEB86659FD93)
POWERS = np.ones(4096, np.uint64)
np.multiply.accumulate(np.full(4095, POLY, np.uint64), out=POWERS[1:])


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the five words that begin at each word; h: hashes of words."""
    out = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        out = out * POLY
        out[: len(h) - k] += h[k:]
    return mix64(out)


def _weighted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest, as two arrays, of the words from each of the ascending
    places in `first` up to the next; h: hashes of words."""
    lengths = np.diff(np.append(first, len(h)))
    weight = POWERS[(np.arange(first[0], len(h)) - np.repeat(first, lengths)) & 4095]
    own = h[first[0] :]
    return tuple(mix64(np.add.reduceat(x * weight, first - first[0])) for x in (own, mix64(own ^ OTHER)))


def _passage_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the PASSAGE words that begin at each word; h: hashes of words."""
    v = np.zeros(len(h), np.uint64)
    for k in range(PASSAGE):
        v *= POLY
        v[: len(h) - k] += h[k:]
    return mix64(v)


def kept_passages(h: np.ndarray, text_ends: np.ndarray, text_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the kept passages of PASSAGE words. text_ends: for each
    word, where its text ends; text_first: where texts begin. Passages stay
    within a text; a text that has any keeps its least one. 64 bits will do:
    nothing is reported for one passage, but for stretches of several."""
    at = np.arange(len(h))
    valid = at + PASSAGE <= text_ends
    if not valid.any():
        return at[:0], h[:0]
    v = np.where(valid, _passage_hashes(h), np.uint64(2**64 - 1))
    picked = [at[:0]]
    for a in range(0, len(v) - WINDOW + 1, 1 << 18):
        part = v[a : a + (1 << 18) + WINDOW - 1]
        picked.append(np.unique(np.lib.stride_tricks.sliding_window_view(part, WINDOW).argmin(1) + np.arange(len(part) - WINDOW + 1)) + a)
    least = np.minimum.reduceat(v, text_first)
    lengths = np.diff(np.append(text_first, len(v)))
    picked.append(np.flatnonzero(v == np.repeat(least, lengths)))
    kept = np.unique(np.concatenate(picked))
    kept = kept[valid[kept]]
    return kept, v[kept]


def _bands(mins: np.ndarray) -> np.ndarray:
    """Hashes of bands from the minima, ROWS to a band."""
    out = np.zeros((len(mins), mins.shape[1] // ROWS), np.uint64)
    for r in range(ROWS):
        out = mix64(out * POLY + mins[:, r::ROWS] + np.arange(out.shape[1], dtype=np.uint64))
    return out


def _units(texts: list[bytes], least: int, n_bands: int, lines: bool = True) -> tuple[np.ndarray, ...] | None:
    """Arrays (text, line, word, words, d1, d2, bands) over several texts: the
    paragraphs of `least` words or more (none unless `lines`), then the kept
    passages, without bands."""
    low = b"\n".join(texts).translate(LOWER)
    raw = np.frombuffer(low, np.uint8)
    starts = word_starts(raw)
    if not len(starts):
        return None
    h = word_hashes(raw, starts)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    text = np.searchsorted(begins, starts, side="right") - 1
    origin = np.searchsorted(starts, begins)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    lead = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(lead, len(starts)))
    long = np.flatnonzero(size >= least) if lines else np.zeros(0, np.int64)
    bands = np.zeros((0, n_bands), np.uint64)
    if len(long):
        # minima over each long line's shingles, all within the line
        factors, addends = _functions(n_bands * ROWS)
        sh = np.append(shingle_hashes(h), np.uint64(0))
        bounds = np.stack([lead[long], lead[long] + size[long] - (SHINGLE - 1)], axis=1).ravel()
        mins = np.empty((len(long), n_bands * ROWS), np.uint64)
        for j in range(n_bands * ROWS):
            mins[:, j] = np.minimum.reduceat(sh * factors[j] + addends[j], bounds)[::2]
        bands = _bands(mins)
    d1, d2 = (d[long] for d in _weighted(h, lead))
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    ends = np.repeat(np.append(first[1:], len(h)), np.diff(np.append(first, len(h))))
    kept, k1 = kept_passages(h, ends, first)
    at = np.concatenate([lead[long], kept])
    words = np.concatenate([size[long], np.full(len(kept), PASSAGE)])
    return text[at], np.arange(len(at)) < len(long), at - origin[text[at]], words, np.concatenate([d1, k1]), np.concatenate([d2, np.zeros(len(kept), np.uint64)]), bands


def _cuts(data: bytes, a: int, b: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts of data[a:b] of about `size` bytes, cut between words."""
    while a < b:
        end = min(b, a + size)
        while end < b and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield a, end
        a = end


def _sections(data: bytes, size: int = 4 << 20) -> Iterator[tuple[int, int, bool, bytes]]:
    """(words before, words repeated, whole, part) of a text in parts of whole
    lines of about `size` bytes; a line that is longer comes in parts of its own,
    cut between words, with whole false. Each part begins with the 49 words
    before it, as a line of its own, so that no stretch of 50 words is cut."""
    at, words, tail = 0, 0, []
    while at < len(data):
        end, whole = len(data), True
        if end - at > size:
            nl = data.rfind(b"\n", at, at + size)
            if nl < at and len(data) - at > size:
                nl, whole = data.find(b"\n", at), False
            end = nl + 1 if nl >= at else len(data)
        for a, b in _cuts(data, at, end, size) if not whole else [(at, end)]:
            own = data[a:b].split()
            yield words - len(tail), len(tail), whole, b" ".join(tail) + b"\n" * bool(tail) + data[a:b]
            words += len(own)
            tail = (tail + own)[-(STRETCH - 1) :]
        at = end


def _long_lines(data: bytes, least: int, n_bands: int, size: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(word, words, d1, d2, bands) of the lines that _sections cuts: digests and
    minima are carried from part to part, so they are those of the line as a
    whole, wherever it stands. Each is an array of one value."""
    factors, addends = _functions(n_bands * ROWS)
    at, before = 0, 0
    while at < len(data):
        nl = data.find(b"\n", at)
        end = nl + 1 if nl >= 0 else len(data)
        if end - at <= size:
            before += len(data[at:end].split())
            at = end
            continue
        n, sums, tail = 0, np.zeros(2, np.uint64), np.zeros(0, np.uint64)
        mins = np.full((1, n_bands * ROWS), np.uint64(2**64 - 1))
        for a, b in _cuts(data, at, end, size):
            raw = np.frombuffer(data[a:b].translate(LOWER), np.uint8)
            h = word_hashes(raw, word_starts(raw))
            weight = POWERS[(n + np.arange(len(h))) & 4095]
            sums += np.array([(h * weight).sum(dtype=np.uint64), (mix64(h ^ OTHER) * weight).sum(dtype=np.uint64)])
            n += len(h)
            both = np.concatenate([tail, h])
            if len(both) >= SHINGLE:
                sh = shingle_hashes(both)[: len(both) - SHINGLE + 1]
                for j in range(n_bands * ROWS):
                    mins[0, j] = min(mins[0, j], (sh * factors[j] + addends[j]).min())
            tail = both[1 - SHINGLE :]
        if n >= least:
            d = mix64(sums)
            yield before, n, d[:1], d[1:], _bands(mins)
        before += n
        at = end


UNIT_NAMES = ["id", "th", "line", "word", "words", "d1", "d2", "bands"]
SECTION = 4 << 20


def paragraph_units(docs: DataFrame, least: int = LEAST, n_bands: int = tune_bands()) -> DataFrame:
    """(id, th, line, word, words, d1, d2, bands) of every paragraph of `least`
    words or more (line true) and of every kept passage (line false, no bands).
    d1, d2: a 128-bit digest of the paragraph's words, A-Z lower-cased; of a
    passage 64 bits, with d2 0."""
    least = max(least, SHINGLE)

    def batch_of(keys: list[pa.Array], text, line, word, words, d1, d2, bands) -> pa.RecordBatch:
        lengths = np.where(line, n_bands, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(bands.ravel().view(np.int64)))
        rows = pa.array(text)
        return pa.RecordBatch.from_arrays([*[k.take(rows) for k in keys], pa.array(line), pa.array(word), pa.array(words.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], names=UNIT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SECTION):
            keys, texts = [batch.column("id"), batch.column("th")], as_bytes(batch.column("text"))
            if len(texts) > 1:
                if got := _units(texts, least, n_bands):
                    yield batch_of(keys, *got)
                continue
            for before, repeated, whole, part in _sections(texts[0], SECTION):
                if got := _units([part], least, n_bands, whole):
                    text, line, word, words, d1, d2, bands = got
                    own = ~line | (word >= repeated)
                    yield batch_of(keys, text[own], line[own], word[own] + before, words[own], d1[own], d2[own], bands[own[: len(bands)]])
            for word, words, d1, d2, bands in _long_lines(texts[0], least, n_bands, SECTION):
                yield batch_of(keys, np.zeros(1, np.int64), np.ones(1, bool), np.array([word]), np.array([words]), d1, d2, bands)

    more = {"line": F.lit(True), "word": F.lit(0).cast("long"), "words": F.lit(0), "d1": F.lit(0).cast("long"), "d2": F.lit(0).cast("long"), "bands": F.array().cast("array<bigint>")}
    return docs.mapInArrow(run, docs.select("id", "th").withColumns(more).schema)


def _text_pass(docs: DataFrame, wanted: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the texts are needed for again, in one pass over those that have any
    of it: the shingles, as sorted distinct hashes, of the paragraphs of `wanted`
    (p, id, th, word, words), and (at, d1) of `hits` (id, th, word, chain) and of
    the passages beside them that show how far each one's stretch goes on: see
    _beside. at: the place, see _numbered. Also (n, id, th), the numbers of the
    texts that have any."""
    none = F.lit(None).cast("long")
    places = wanted.select("id", "th", F.struct("p", "word", "words", none.alias("chain")).alias("x")).unionByName(hits.select("id", "th", F.struct(none.alias("p"), "word", F.lit(None).cast("int").alias("words"), "chain").alias("x")))
    places = _numbered(places.groupBy("id", "th").agg(F.sort_array(F.collect_list("x")).alias("places")))
    places = stash(places.withColumnsRenamed({"id": "at_id", "th": "at_th"}), "substring-places")
    on = (F.col("th") == F.col("at_th")) & F.col("id").eqNullSafe(F.col("at_id"))
    d = join_bounded(docs, places, on, row_bytes=32 + 32 * F.size("places")).select("n", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SECTION):
            at, d1 = [], []
            ps, sets = [], []
            for number, data, places in zip(batch.column("n").to_pylist(), as_bytes(batch.column("text")), batch.column("places")):
                x = places.values
                p, word, words, chain = (x.field(k) for k in ("p", "word", "words", "chain"))
                # sorted, with the passages first, as their p is null
                n = p.null_count
                if n:
                    for w, h in _extend(data, word.slice(0, n).to_numpy(), chain.slice(0, n).to_numpy()):
                        at.append(w + (number << PLACE)), d1.append(h)
                for q, s in _sets(data, *[c.slice(n).to_numpy() for c in (p, word, words)]) if n < len(x) else ():
                    ps.append(q), sets.append(s)
                if sum(map(len, sets)) > 1 << 20:
                    yield batch_of(p=pa.array(ps, pa.int64()), shingles=pa.array(sets, pa.list_(pa.int64())))
                    ps, sets = [], []
            if at:
                yield batch_of(at=pa.array(np.concatenate(at)), d1=pa.array(np.concatenate(d1)))
            if ps:
                yield batch_of(p=pa.array(ps, pa.int64()), shingles=pa.array(sets, pa.list_(pa.int64())))

    def batch_of(**columns: pa.Array) -> pa.RecordBatch:
        kinds = {"p": pa.int64(), "shingles": pa.list_(pa.int64()), "at": pa.int64(), "d1": pa.int64()}
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, kind)) for n, kind in kinds.items()], names=[*kinds])

    def _extend(data: bytes, hits: np.ndarray, chains: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wanted = np.union1d(hits, _beside(hits, chains))
        for before, repeated, _, part in _sections(data, SECTION):
            raw = np.frombuffer(part.translate(LOWER), np.uint8)
            h = word_hashes(raw, word_starts(raw))
            # what lies in the repeated words alone was in the part before
            lo, hi = np.searchsorted(wanted, [before + max(0, repeated - PASSAGE + 1), before + len(h) - PASSAGE + 1])
            if lo < hi:
                yield wanted[lo:hi], _passage_hashes(h)[wanted[lo:hi] - before].view(np.int64)

    def _sets(data: bytes, ps: np.ndarray, word: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        raw = np.frombuffer(data.translate(LOWER), np.uint8)
        starts = word_starts(raw)
        for p, a, n in zip(ps, word, words):
            part = raw[starts[a] : starts[a + n] if a + n < len(starts) else len(raw)]
            h = word_hashes(part, word_starts(part))
            yield int(p), np.unique(shingle_hashes(h)[: len(h) - SHINGLE + 1]).view(np.int64)

    return d.mapInArrow(run, "p long, shingles array<long>, at long, d1 long"), places.select("n", F.col("at_id").alias("id"), F.col("at_th").alias("th"))


def _numbered(texts: DataFrame) -> DataFrame:
    """texts (id, th, ...) with n: 0, 1, 2... in their order. n, shifted by PLACE,
    and a word of the text make a place as one number, so that places compare as
    id, th and word do."""
    rows = 1 << 33  # see monotonically_increasing_id
    # written first: a sort by ranges reads its input twice
    texts = stash(texts, "substring-unnumbered")
    t = stash(texts.orderBy("id", "th").withColumn("i", F.monotonically_increasing_id()), "substring-sorted")
    discard(texts)
    part = F.shiftright("i", 33)
    # one row for each range
    sizes = sorted((r["part"], r["n"]) for r in t.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    firsts = [(k, sum(n for _, n in sizes[:j])) for j, (k, _) in enumerate(sizes)]
    firsts = texts.sparkSession.createDataFrame(firsts, "part long, first long")
    return t.join(F.broadcast(firsts), part == F.col("part")).withColumn("n", F.col("first") + F.col("i") % rows).drop("part", "first", "i")


def _chained(hits: DataFrame) -> DataFrame:
    """hits (id, th, word, d1, head) with a number `chain` that two hits of a
    document share where all that has one has the other in the same place beside
    it: for a later copy, by the first document and the shift to it; for a first
    copy, by the documents that have it and their shifts, summed with weights.
    Between hits of a chain that touch, no document begins or ends to agree."""
    place = F.struct("id", "th", "word")
    weight = F.xxhash64("id", "th").bitwiseAND(0xFFF)
    far = F.xxhash64("id", "th").bitwiseAND(0xFFFFFFFF)
    first = hits.groupBy("d1", "head").agg(F.count("*").alias("n"), F.try_sum(far).alias("docs"), F.try_sum(weight).alias("w"), F.try_sum(weight * F.col("word")).alias("at"))
    # sums that don't fit are null and make a chain of one
    sums = F.coalesce(F.xxhash64("n", "docs", "w", F.col("at") - F.col("w") * F.col("head.word")) .bitwiseXOR(F.col("at") * 0).bitwiseXOR(F.col("docs") * 0), F.xxhash64("head"))
    later = F.xxhash64("head.id", "head.th", F.col("word") - F.col("head.word"), F.lit(1))
    return hits.where(place != F.col("head")).select("id", "th", "word", later.alias("chain")).unionByName(first.select("head.*", sums.alias("chain")))


def _beside(hits: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """The words, ascending, where passages begin that are to be compared: those
    less than WINDOW from a hit. Between two neighbouring hits of one chain (see
    _chained) only those that reach the words, ten or so, that neither hit spans.
    hits: ascending words; chains: a number for each."""
    gap = np.diff(hits)
    linked = (gap < WINDOW + 1) & (chains[1:] == chains[:-1])
    reach = np.where(linked, np.clip(gap - PASSAGE, 0, None), WINDOW - 1)
    steps = np.arange(1, WINDOW)
    right = (hits[:, None] + steps)[steps <= np.append(reach, WINDOW - 1)[:, None]]
    left = (hits[:, None] - steps)[steps <= np.append(WINDOW - 1, reach)[:, None]]
    out = np.unique(np.concatenate([right, left]))
    # a hit's own steps may lead beyond the next one: there the next one's count
    k = np.searchsorted(hits, out)
    inner = (k > 0) & (k < len(hits))
    inner[inner] &= linked[k[inner] - 1]
    a, b = hits[np.maximum(k - 1, 0)], hits[np.minimum(k, len(hits) - 1)]
    near = np.minimum(out - a, b - out) <= b - a - PASSAGE
    return out[~np.isin(out, hits) & (out >= 0) & (~inner | near)]


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is exactly at least that."""
    x = pairs.join(sets.select(F.col("p").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("p").alias("b"), F.col("shingles").alias("sb")), "b")
    return x.where(_alike(F.col("sa"), F.col("sb"), similarity)).select("a", "b")


def _alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets are similar; their sizes are compared first."""
    fits = F.least(F.size(x), F.size(y)) >= similarity * F.greatest(F.size(x), F.size(y)) - 1e-9
    both = F.size(F.array_intersect(x, y))
    return fits & (both >= similarity * (F.size(x) + F.size(y) - both) - 1e-9)


def rare_prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(p, prefix): of each set (p, shingles), the rarest shingles, as many as
    leave fewer than `similarity` of the set. Two sets of at least that Jaccard
    similarity share a shingle of both prefixes, whatever the order, if it is one
    for all sets; with the rarest first, few others do. Shingles that one set
    alone has are left out."""
    tokens = sets.select("p", F.explode("shingles").alias("s"))
    rare = stash(tokens.groupBy("s").agg(F.count("*").alias("n")), "substring-shingles")
    found = tokens.join(rare, "s").groupBy("p").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("x"))
    head = F.slice("x", F.lit(1), F.size("x") - F.ceil(similarity * F.size("x") - 1e-9).cast("int") + 1)
    return found.select("p", F.transform(F.filter(head, lambda t: t["n"] > 1), lambda t: t["s"]).alias("prefix"))


def _linked_within(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members: (band, p, root, bands). The similar pairs (a, b) of a bucket whose
    roots differ.

    A bucket is hit by chance too, so many of its pairs may be far under the
    similarity. They aren't compared: within a bucket two sets meet
    only where they share a rare shingle (rare_prefixes), which loses no similar
    pair. The join's condition is the exact check, made at the first bucket and
    shingle that a pair shares, so only links leave the join."""
    own = sets.join(members.select("p").distinct(), "p", "left_semi")
    pre = stash(rare_prefixes(stash(own, "substring-own"), similarity), "substring-prefixes")
    m = members.join(pre, "p").join(sets, "p").select("band", "p", "root", "bands", "shingles", "prefix", F.explode("prefix").alias("s"))
    m = stash(m, "substring-met")
    x, y = m.alias("x"), m.alias("y")
    first = lambda c, v: F.get(F.array_intersect(f"x.{c}", f"y.{c}"), F.lit(0)) == F.col(f"x.{v}")
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.p") < F.col("y.p")) & (F.col("x.root") != F.col("y.root"))
    return x.join(y, on & first("bands", "band") & first("prefix", "s") & _alike(F.col("x.shingles"), F.col("y.shingles"), similarity)).select(F.col("x.p").alias("a"), F.col("y.p").alias("b"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """One row per repeated passage: key, word and words (where it stands in the
    text, by words), near (a paragraph found by MinHash) or not, class_id and
    class_word (where the first of its class stands) and removed (false for
    that first one).

    Paragraphs are lines of `least` words or more (five at least). Equal ones,
    by a 128-bit digest, are one class and are banded once; bands are tuned for
    a recall of 0.999 at the similarity, and pairs that meet are verified by the
    exact Jaccard similarity of their sets of five words. Within a band's bucket
    all are first compared with the least one; in buckets that then hold several
    components, pairs between components meet by rare shingles, so a large group
    isn't paired out. Classes are the components of verified pairs.

    Passages that repeat inside otherwise different paragraphs, or over several
    lines, are found by kept passages of 20 words (see WINDOW): of 50 shared
    words in a row, one at least is kept in both texts, and every place of the
    shared words is less than WINDOW words from one. So the passages that near a
    kept one that repeats are compared again, and those that repeat are merged to
    stretches where they overlap or touch. A stretch of 50 words or more is
    reported, in full; shorter ones only as paragraphs. It is left out where it
    lies in a paragraph that is removed; kept passages in a paragraph that equals
    an earlier one aren't followed up. Passages whose first copies stand in
    different documents make rows of their own, as do first copies; such rows of
    a document can overlap, and a word is a later copy's if any removed row spans
    it.

    Null and empty texts have no passages. A null key comes first and is a key;
    rows that share a key but not the text are ordered by a hash; rows with an
    equal key and text are one document, which repeats itself only where the text
    does. Keys may be of any type that has an order. Columns other than key and
    text aren't used; a table without repeats gives an empty one.
    """
    spark = docs.sparkSession
    d = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    # th tells rows apart that share a key; where none do, it is one number
    shared = docs.where(F.col(text).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    th = F.xxhash64("id", "text") if shared.limit(1).count() else F.lit(0).cast("long")
    d = d.select("id", th.alias("th"), "text")
    units = stash(paragraph_units(d, least, tune_bands(similarity)), "substring-units")
    place = F.struct("id", "th", "word")

    classes = units.where("line").groupBy("d1", "d2").agg(F.min(F.struct("id", "th", "word", "words", "bands")).alias("m"), F.max(place).alias("hi"))
    # classes are numbered as they are written, so numbers hold from here on
    classes = stash(classes.select(F.monotonically_increasing_id().alias("p"), "d1", "d2", "m.*", (F.struct("m.id", "m.th", "m.word") != F.col("hi")).alias("again")), "substring-classes")
    lines = stash(units.where("line").select("id", "th", "word", "words", "d1", "d2"), "substring-lines")
    release(spark)

    kept = units.where("not line").select("id", "th", "word", "d1")
    twice = kept.groupBy("d1").agg(F.min(place).alias("head"), F.max(place).alias("last")).where("head <> last").drop("last")
    # written first: a join right above the grouping could not split a hot passage
    twice = stash(twice, "substring-twice-kept")
    release(spark)
    hits = kept.join(twice, "d1")
    repeated = stash(classes.where("again").select("d1", "d2", F.col("id").alias("i0"), F.col("th").alias("t0"), F.col("word").alias("w0")), "substring-again")
    later = join_bounded(lines, repeated, ["d1", "d2"]).where(~(F.col("id").eqNullSafe(F.col("i0")) & (F.col("th") == F.col("t0")) & (F.col("word") == F.col("w0"))))
    hits = stash(_outside(hits, later, PASSAGE), "substring-hits")
    discard(units)
    release(spark)
    bands = classes.select("p", F.explode("bands").alias("band"))
    buckets = stash(bands.groupBy("band").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n")).where("n > 1"), "substring-buckets")
    crowded = stash(join_bounded(bands, stash(buckets.where("n > 2").select("band", "lo"), "substring-crowded"), "band"), "substring-members")
    star = buckets.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(crowded.where("p <> lo").select(F.col("lo").alias("a"), F.col("p").alias("b"))).distinct()
    star = stash(star, "substring-stars")
    wanted = star.select(F.col("a").alias("q")).unionByName(star.select(F.col("b").alias("q"))).unionByName(crowded.select(F.col("p").alias("q"))).distinct()
    wanted = classes.join(stash(wanted, "substring-wanted"), F.col("p") == F.col("q"), "left_semi").select("p", "id", "th", "word", "words")
    release(spark)

    again, numbers = _text_pass(d, wanted, _chained(hits))
    again = stash(again, "substring-texts")
    discard(hits)
    release(spark)
    sets = stash(again.where("p is not null").select("p", "shingles").dropDuplicates(["p"]), "substring-sets")
    release(spark)
    runs = stash(_runs(again.where("p is null").select("at", "d1"), numbers), "substring-runs")
    discard(again)
    release(spark)

    first = stash(_similar(star, sets, similarity), "substring-links")
    roots = connected_components(first, "substring-roots")
    c = crowded.join(roots, crowded["p"] == roots["node"], "left").select("band", "p", F.coalesce("root", "p").alias("root"))
    mixed = c.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("band")
    c = stash(c.join(stash(mixed, "substring-bands"), "band", "left_semi").join(classes.select("p", "bands"), "p"), "substring-mixed")
    release(spark)
    cross = stash(_linked_within(c, sets, similarity), "substring-cross")
    discard(sets)
    release(spark)
    near = connected_components(first.unionByName(cross), "substring-components")
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())

    keep = classes.join(near, classes["p"] == near["node"], "left").where(F.col("again") | F.col("root").isNotNull()).select("d1", "d2", F.coalesce("root", "p").alias("class"), "id", "th", "word")
    keep = stash(keep, "substring-repeats")
    discard(classes)
    head = stash(keep.groupBy("class").agg(F.min(place).alias("head")), "substring-heads")
    label = stash(keep.join(head, "class").select("d1", "d2", "head"), "substring-labels")
    found = join_bounded(lines, label, ["d1", "d2"]).select("id", "th", "word", "words", F.lit(True).alias("near"), F.col("head.id").alias("class_id"), F.col("head.word").alias("class_word"), (place != F.col("head")).alias("removed"))
    found = stash(found.distinct(), "substring-paragraphs")
    discard(lines)
    release(spark)

    # that belong to a stretch of 50 words or more, whatever first copies it has
    order = Window.partitionBy("id", "th").orderBy("word", "end")
    runs = runs.withColumn("new", F.coalesce((F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) < F.col("word")).cast("int"), F.lit(1))).withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("id", "th", "stretch")
    runs = runs.withColumn("size", F.max("end").over(whole) - F.min("word").over(whole)).where(F.col("size") >= STRETCH)
    runs = runs.select("id", "th", "word", (F.col("end") - F.col("word")).cast("int").alias("words"), F.lit(False).alias("near"), "class_id", "class_word", "removed")
    # a run inside one paragraph that is removed already adds nothing
    inside = _outside(runs, found.where("removed"), F.col("words"))
    return found.unionByName(inside).drop("th").withColumnRenamed("id", key)


def _runs(passages: DataFrame, numbers: DataFrame) -> DataFrame:
    """Runs of repeated passages (at, d1; see _text_pass) that overlap or touch:
    one for each document of first copies, and first copies apart from later
    ones. numbers: (n, id, th) of the texts."""
    twice = passages.groupBy("d1").agg(F.min("at").alias("head"), F.max("at").alias("last")).where("head <> last").drop("last")
    # written first: a join right above the grouping could not split a hot passage
    twice = stash(twice, "substring-twice-all")
    release(numbers.sparkSession)
    # dealt out by the text before there are more columns: rows are two numbers
    hit = passages.join(twice, "d1").select("at", "head").repartition(F.shiftright("at", PLACE))
    hit = hit.select("at", "head", F.shiftright("at", PLACE).alias("n"), F.shiftright("head", PLACE).alias("head_n"), (F.col("at") != F.col("head")).alias("later"))
    order = Window.partitionBy("n", "head_n", "later").orderBy("at")
    new = F.coalesce((F.lag("at").over(order) + PASSAGE < F.col("at")).cast("int"), F.lit(1))
    runs = hit.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("n", "head_n", "later", "run").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.max(F.when(F.col("new") == 1, F.col("head"))).alias("head"))
    runs = runs.join(numbers, "n").join(numbers.select(F.col("n").alias("head_n"), F.col("id").alias("class_id")), "head_n")
    word = lambda c: F.col(c).bitwiseAND((1 << PLACE) - 1)
    return runs.select("id", "th", word("at").alias("word"), (word("last") + PASSAGE).alias("end"), "class_id", word("head").alias("class_word"), F.col("later").alias("removed"))


def _outside(places: DataFrame, spans: DataFrame, words: Column | int) -> DataFrame:
    """The places (id, th, word) that don't lie, `words` long, in one of spans (id,
    th, word, words)."""
    s = spans.select(F.col("id").alias("fid"), F.col("th").alias("fth"), F.col("word").alias("fw"), F.col("words").alias("fn"))
    on = (F.col("th") == F.col("fth")) & F.col("id").eqNullSafe(F.col("fid"))
    return places.join(s, on & (F.col("word") >= F.col("fw")) & (F.col("word") + words <= F.col("fw") + F.col("fn")), "left_anti")


def op10(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs)
