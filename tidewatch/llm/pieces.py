"""SentencePiece BPE by backtracking over longest matches, and its inverse."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

SPACE = "▁"
#: Words, and pairs of tokens, that a worker remembers; characters of a section.
MEMORY, PAIRS, SECTION = 400_000, 500_000, 1 << 20
#: In front of the first token.
START = 0
codecs.register_error("byte by byte", lambda e: ("�", e.start + 1))


class Pieces:
    """Encodes as the merges of a sentencepiece BPE model do, without its encoder.

    Merging is greedy: of all adjacent symbols whose concatenation is a piece,
    those of the highest score, leftmost first. So tokens t1..tn are a text's
    encoding if and only if no merge crosses a boundary, that is, if merging
    ti + ti+1 again from characters gives these two for every i; and a prefix of
    a text that ends at a boundary has one encoding. `run` therefore takes the
    longest piece at each place (Aho-Corasick finds them all in one pass), goes
    to shorter ones where a neighbour disagrees, steps back where none is left,
    and marks that place in a bitfield: it fails whatever led there.

    Symbols are numbers: the model's ids, then the characters that occur in
    pieces only, then one for all other characters, `other`.
    """

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.unknown, self.end, self.begin = sp.unk_id(), sp.eos_id(), sp.bos_id()
        bytes_ = {int(names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.fallback = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.decimal = [str(i) for i in range(size)]
        # the inverse: bytes of each id; the first piece loses the prefix
        out = {i: bytes([b]) for b, i in bytes_.items()} | {i: names[i].replace(SPACE, " ").encode() for i in plain}
        self.out = [out.get(i, b"") for i in range(size)]
        self.out[self.unknown] = sp.decode([self.unknown]).encode()
        self.strips = {i for i in plain if names[i].startswith(SPACE) and sp.decode([i]) == names[i][1:].replace(SPACE, " ")}
        # symbols, and from each to the longest shorter one that it begins with
        letters = sorted({c for p in self.score for c in p} - self.score.keys())
        stranger = next(c for c in map(chr, range(0x10FFFF, 0, -1)) if c not in self.score and c not in letters)
        symbols = {names[i]: i for i in plain} | {c: size + k for k, c in enumerate(letters)}
        self.other = size + len(letters)
        self.names = [*names, *letters, stranger]
        self.length = [len(n) for n in self.names]
        self.shorter = [-1] * len(self.names)
        self.machine = ahocorasick.Automaton()
        for symbol, i in symbols.items():
            self.shorter[i] = next((symbols[symbol[:k]] for k in range(len(symbol) - 1, 0, -1) if symbol[:k] in symbols), -1)
            self.machine.add_word(symbol, i)
        self.machine.make_automaton()
        self.words, self.walls = self._walls()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _walls(self) -> tuple[re.Pattern, bool]:
        """A pattern for words: no merge crosses their ends, as no piece has
        such neighbours inside; and whether words end where a space begins."""
        letter = re.compile(r"[^\W\d_]").fullmatch
        inner = {pair for p in self.score for pair in zip(p, p[1:])}
        if any(b == SPACE != a for a, b in inner):
            return re.compile(r"(?s:.+)"), False
        if any(a != SPACE and bool(letter(a)) != bool(letter(b)) for a, b in inner):
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), True
        return re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}*(?:(?!{SPACE})[\W\d_])+|{SPACE}+"), True

    def merged(self, text: str) -> list[str]:
        """Greedy merges of a short text from its characters."""
        parts, score = list(text), self.score.get
        while True:
            best = None
            for i, pair in enumerate(zip(parts, parts[1:])):
                s = score(pair[0] + pair[1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Merging the texts of a and b again gives these two; after START, b by
        itself."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        names = [self.names[a], self.names[b]] if a != START else [self.names[b]]
        ok = self.pairs[a << 24 | b] = self.merged("".join(names)) == names
        return ok

    def run(self, text: str) -> tuple[int, ...]:
        """Ids of a text by itself."""
        n, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        longest = [self.other] * n
        for end, i in self.machine.iter(text):
            longest[end - length[i] + 1] = i
        tokens: list[int] = []
        failed = None
        last, at, i = START, 0, longest[0]
        while True:
            end = at + length[i]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                ok = pairs.get(last << 24 | i)
                if ok or ok is None and self.fits(last, i):
                    tokens.append(i)
                    if end == n:
                        break
                    last, at, i = i, end, longest[end]
                    continue
            i = shorter[i]
            if i < 0:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                i = tokens.pop()
                at -= length[i]
                last = tokens[-1] if tokens else START
        if max(tokens) < self.size:
            return tuple(tokens)
        out, at = [], 0
        for i in tokens:
            end = at + length[i]
            if i < self.size:
                out.append(i)
            else:
                out += [self.fallback[b] for b in text[at:end].encode()] if self.fallback else [self.unknown]
            at = end
        return tuple(out)

    def sections(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, section by section, without begin and end."""
        text = self.sp.normalize(text) if text else ""
        known, at = self.known, 0
        while at < len(text):
            cut = None
            if self.walls and len(text) - at > SECTION:
                cut = text.find(SPACE, at + SECTION)
                while cut > 0 and text[cut - 1] == SPACE:
                    cut = text.find(SPACE, cut + 1)
                cut = cut if cut > 0 else None
            words = self.words.findall(text, at, len(text) if cut is None else cut)
            ids = list(map(known.get, words))
            if None in ids:
                for k, got in enumerate(ids):
                    if got is None:
                        w = words[k]
                        got = known.get(w) or self.run(w)
                        if len(known) >= MEMORY:
                            known.clear()
                        if len(w) <= 64:
                            known[w] = got
                        ids[k] = got
            yield list(chain.from_iterable(ids))
            at = len(text) if cut is None else cut

    def encode(self, text: str, begin: bool = False, end: bool = True) -> list[int]:
        """The ids of a text."""
        ids = list(chain.from_iterable(self.sections(text)))
        if self.fallback is None:
            # the library gives one id for a run of unknown characters
            ids = [x for x, before in zip(ids, [None, *ids]) if x != self.unknown or before != x]
        return [*([self.begin] if begin else []), *ids, *([self.end] if end else [])]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids: pieces joined, U+2581 as space, byte pieces as UTF-8
        with U+FFFD for each byte that isn't; control ids give nothing, and the
        space that encoding put in front of the first piece goes."""
        data = b"".join(map(self.out.__getitem__, ids))
        if first and next((i for i in ids if self.out[i]), None) in self.strips:
            data = data[1:]
        return data.decode("utf-8", "byte by byte")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids (with an end id), digest of the ids in decimal with
        single spaces, digest of the text they decode to."""
        n, written, read = 1, hashlib.sha256(), hashlib.sha256()
        for ids in self.sections(text) if self.fallback else [self.encode(text, end=False)]:
            written.update(" ".join(map(self.decimal.__getitem__, ids)).encode() + b" ")
            read.update(self.decode(ids, n == 1).encode())
            n += len(ids)
        written.update(self.decimal[self.end].encode())
        return n, written.hexdigest(), read.hexdigest()


#: A worker's codec of the last model, so that tasks share what it remembers.
_CODEC: dict[str, Pieces] = {}


def _codec(shared: Broadcast) -> Pieces:
    digest, model = shared.value
    if digest not in _CODEC:
        _CODEC.clear()
        _CODEC[digest] = Pieces(model)
    return _CODEC[digest]


def _share(df: DataFrame, path: str) -> Broadcast:
    """The model is the same size whatever the corpus, about 0.5 MB. A model that
    doesn't merge (unigram, word) is refused: a part of its own pieces in a row
    is encoded both ways."""
    with open(path, "rb") as f:
        model = f.read()
    codec = Pieces(model)
    probe = " ".join(codec.names[: codec.size : max(1, codec.size // 2000)])
    if codec.encode(probe) != codec.sp.encode(probe, add_eos=True):
        raise ValueError(f"{path} is not a BPE model")
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model))


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids", begin: bool = False, end: bool = True) -> DataFrame:
    """docs and an array<int> column of token ids, as the sentencepiece library
    encodes with the BPE model in the file `model`; `begin` and `end` add the
    model's ids. Null text counts as empty. A column named as `out` is replaced."""
    shared = _share(docs, model)
    docs = docs.drop(out) if out != text else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches, text):
            ids = [codec.encode(t or "", begin, end) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.array().cast("array<int>")).schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and a string column, the text of the ids; null ids give an empty text.
    An id outside the vocabulary fails the job. A column named as `out` is
    replaced."""
    shared = _share(df, model)
    df = df.drop(out) if out != ids else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches, ids, 1 << 20):
            got = [codec.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit("")).schema)


def piece_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, the digest of the ids in decimal with single
    spaces, the digest of the text that the ids decode to. Encodes (with an end
    id) and decodes within one task, so ids never leave it; null text counts as
    empty (the end id alone), repeated rows and null keys keep their rows, and
    other columns aren't read."""
    d = docs.select(F.col(key), F.col(text).alias("text"))
    shared = _share(d, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches, "text"):
            rows = [codec.digests(t or "") for t in batch.column("text").to_pylist()]
            n, first, second = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = d.select(key).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    return d.mapInArrow(run, schema)


def op11(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    return piece_digests(docs, public.path("piece_bpe_32k.model"))
