"""Document fingerprints: a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stash

#: Lanes of 32 bits that prove equality, and lanes of 16 bits whose signed sums
#: estimate how much two multisets share.
WIDE, SIGNS = 16, 64
#: A paragraph ends at line feeds, and after . ! or ? before white space: many
#: texts are one line, and likeness needs pieces that two texts can share.
CUT = r"\n+|(?<=[.!?])\s+"

#: The longest part of a text that ends right before a paragraph.
START = r"(?s)^.*(?:\n|[.!?]\s+)(?=\S)"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), CUT), lambda p: p != "")


def _lane_sums() -> list[Column]:
    """Sums over a group of paragraphs. Each wide lane adds 32 bits of a hash of
    the paragraph's 128-bit digest (taken as two hashes of it); no text has 2^31
    paragraphs, so the sums fit a long. Sign lanes count set bits, two counters of 32 bits to a long."""
    low = F.lit(0xFFFFFFFF).cast("long")
    sums = []
    for i in range(WIDE // 2):
        h = F.col(f"h{i}")
        sums += [F.sum(h.bitwiseAND(low)).alias(f"w{2 * i}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"w{2 * i + 1}")]
    pair = F.lit(1 << 32 | 1).cast("long")
    return sums + [F.sum(F.shiftrightunsigned("h-1", i).bitwiseAND(pair)).alias(f"s{i}") for i in range(SIGNS // 2)]


def _vector() -> tuple[Column, Column]:
    """From the sums: the 16 wide lanes modulo 2^32 and the 64 signed lanes."""
    low = F.lit(0xFFFFFFFF).cast("long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    wide = F.array(*[zero(f"w{i}").bitwiseAND(low) for i in range(WIDE)])
    ones = [zero(f"s{i}").bitwiseAND(low) for i in range(SIGNS // 2)] + [F.shiftrightunsigned(zero(f"s{i}"), 32) for i in range(SIGNS // 2)]
    return wide, F.array(*[2 * x - F.col("n") for x in ones])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the union of two multisets (sign 1), or of a without b (-1):
    wide lanes modulo 2^32, count and signed lanes exactly."""
    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"),
        F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32).cast("long"))).alias("wide"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: x + sign * y).alias("signs"),
    )


def as_hex(v: Column) -> Column:
    """Wide lanes, 8 digits each, then signed lanes modulo 2^16, 4 digits each."""
    wide = F.transform(v["wide"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    signs = F.transform(v["signs"], lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 16).cast("long")))), 4, "0"))
    return F.concat(F.array_join(wide, ""), F.array_join(signs, ""))


def likeness(a: Column, b: Column) -> Column:
    """1 where the fingerprints are equal. Else an estimate of the share of
    paragraphs in common (2 |A and B| / (|A| + |B|)): the mean square of the
    signed lanes' differences estimates the squared distance of the multisets;
    at least 0 and below 1."""
    square = F.aggregate(F.zip_with(a["signs"], b["signs"], lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x) / SIGNS
    n = (a["n"] + b["n"]).cast("double")
    rough = F.when(n > 0, 1 - square / n).otherwise(F.lit(0.0))
    return F.when(a["wide"] == b["wide"], F.lit(1.0)).otherwise(F.least(F.lit(0.999), F.greatest(F.lit(0.0), rough)))


def likeness_error(a: int, b: int, shared: int) -> float:
    """Standard error of `likeness` for texts of a and b paragraphs, `shared` of
    them in common and all different: sqrt(2 / SIGNS) times the estimated
    distance over a + b."""
    return (2 / SIGNS) ** 0.5 * (1 - 2 * shared / max(a + b, 1))


def fingerprint_pieces(df: DataFrame, keys: list[str], pieces: dict[str, Column]) -> DataFrame:
    """One row per group of `keys` (which must tell rows apart), with a vector
    struct(n, wide, signs) of each array of paragraphs in `pieces`.

    Paragraphs are exploded, hashed once and summed per row and array. All sums
    are combined before any exchange, and there is none where df is already
    dealt by a part of `keys`. Order of paragraphs doesn't count, repeats do;
    an empty or null array is the empty multiset."""
    which = F.explode(F.array(*[F.struct(F.lit(out).alias("out"), p.alias("pieces")) for out, p in pieces.items()])).alias("t")
    d = df.select(*keys, which).select(*keys, "t.out", F.explode_outer("t.pieces").alias("piece"))
    d = d.select(*keys, "out", F.md5(F.col("piece").cast("binary")).alias("digest"))
    d = d.select(*keys, "out", F.col("digest").isNotNull().alias("there"), F.xxhash64("digest").alias("d1"), F.xxhash64(F.lit(1), "digest").alias("d2"))
    hashes = [F.when(F.col("there"), F.xxhash64(F.lit(i), "d1", "d2")).alias(f"h{i}") for i in range(-1, WIDE // 2)]
    s = d.select(*keys, "out", "there", *hashes).groupBy(*keys, "out").agg(F.count_if("there").alias("n"), *_lane_sums())
    wide, signs = _vector()
    s = s.select(*keys, "out", F.struct("n", wide.alias("wide"), signs.alias("signs")).alias("v"))
    return s.groupBy(*keys).agg(*[F.first(F.when(F.col("out") == out, F.col("v")), ignorenulls=True).alias(out) for out in pieces])


def fingerprint_texts(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """Vectors of whole texts (column: output); null and empty texts are the
    empty multiset. See fingerprint_pieces."""
    return fingerprint_pieces(df, keys, {out: paragraphs(F.col(c)) for c, out in texts.items()})


def _place(key: Column, tie: Column, cuts: list[int], n: int) -> Column:
    """A bucket 0 to n for a key, ascending in (key, tie): the key's place
    between the sorted cuts, which are quantiles, taken as linear between two of
    them; a key that several cuts equal is spread over them by the tie, a
    uniform hash."""
    arr = F.lit(cuts).cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))

    def below(least: bool) -> Column:
        """How many cuts are under the key (or at most it), by halving."""
        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            here = F.get(arr, mid) < key if least else F.get(arr, mid) <= key
            done = s["lo"] >= s["hi"]
            return F.struct(F.when(done | ~here, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | here, s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda s: s["lo"])

    lo, hi = below(True), below(False)
    even = tie.cast("double") / 2.0**64 + 0.5
    left, right = F.get(arr, lo - 1).cast("double"), F.get(arr, lo).cast("double")
    between = lo - 1 + F.coalesce((key.cast("double") - left) / (right - left), F.lit(0.5))
    at = F.when(hi > lo, lo + (hi - lo - 1) * even).otherwise(between)
    return F.floor(F.greatest(F.lit(0.0), at) * n / max(1, len(cuts) - 1)).cast("long")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 2000, cells: int = 1000) -> DataFrame:
    """(bucket, rn, key, text, next_text, last): each row with the text of the
    next in ascending key order (nulls first, ties by a hash of the text), the
    last with that of the first; last: whether it is the last of its bucket.

    Rows are dealt to buckets of about `rows` rows, however many there are, by
    their place among at most `cells` quantiles of the key; null keys and keys
    that hold many rows are dealt by the text's hash. Each bucket is one window
    group that Spark can spill. A bucket's last row gets the first text of the
    next bucket that has any, by a join of one row per bucket."""
    d = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = d.agg(F.count("*").alias("n"), F.count(key).alias("keys")).first()
    cuts = d.select(F.percentile_approx(key, [i / cells for i in range(cells + 1)], 10 * cells).alias("c")).first()["c"] if count["keys"] > rows else None
    n, nulls = count["keys"] // rows, (count["n"] - count["keys"]) // rows
    tie = F.xxhash64("text")
    placed = _place(F.col(key), tie, cuts, n) if cuts else F.lit(0).cast("long")
    unkeyed = -1 - nulls + F.floor((tie.cast("double") / 2.0**64 + 0.5) * nulls).cast("long")
    d = d.select(F.when(F.col(key).isNull(), unkeyed).otherwise(placed).alias("bucket"), key, tie.alias("tie"), "text")
    w = Window.partitionBy("bucket").orderBy(key, "tie", "text")
    inside = d.select("bucket", F.row_number().over(w).alias("rn"), key, "text", F.lead("text").over(w).alias("following"))
    heads = stash(d.groupBy("bucket").agg(F.min(F.struct(key, "tie", "text")).alias("h")).select("bucket", F.col("h.text").alias("head")), "range-heads")
    order = Window.orderBy("bucket")
    ranges = heads.select(F.col("bucket").alias("at"), F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("then"))
    heads = stash(ranges.join(heads, ranges["then"] == heads["bucket"]).select("at", "head"), "range-next")
    joined = inside.join(heads, inside["bucket"] == heads["at"])
    return joined.select("bucket", "rn", key, "text", F.coalesce("following", "head").alias("next_text"), F.col("following").isNull().alias("last"))


def op8(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of edited ones (see the query's contract).

    The paragraphs before the cut are in both texts, so a text's vector is that
    of the kept paragraphs plus that of the removed ones, and the edited text's
    is its own, less the removed, plus the inserted ones. The next document's
    vector is its own row's, one place on in the bucket; only the last row of a
    bucket has it computed beside.

    Null text counts as empty. Repeated rows, rows that share a key and rows
    with a null key stay, each followed by the next in (key, hash of the text)
    order, nulls first; a single row follows itself. An empty table gives an
    empty one; other columns aren't used."""
    d = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.select("bucket", "rn", "last", "doc_id", "text", "next_text", F.length("text").alias("n_chars"), half.alias("half"))
    first = F.substring("text", F.lit(1), F.col("n_chars") - F.col("half"))
    d = d.select("*", first.alias("first"), F.concat(first, F.substring("next_text", F.lit(1), F.col("half"))).alias("edited"))
    # up to the last place before the cut where a paragraph begins for certain
    start = F.length(F.regexp_extract("first", START, 0))
    d = d.select("bucket", "rn", "last", "doc_id", F.col("n_chars").cast("long"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "next_text", "edited", start.alias("start"))
    rest = lambda c: paragraphs(F.substring(c, F.col("start") + 1, F.length(c)))
    v = fingerprint_pieces(d, ["bucket", "rn", "last", "doc_id", "n_chars", "edited_sha256"], {"kept": paragraphs(F.substring("text", F.lit(1), F.col("start"))), "removed": rest(F.col("text")), "inserted": rest(F.col("edited")), "after": F.when(F.col("last"), paragraphs(F.col("next_text")))})
    v = v.select("bucket", "rn", "last", "doc_id", "n_chars", "edited_sha256", combine(F.col("kept"), F.col("removed")).alias("own"), "removed", "inserted", "after")
    follows = F.lead("own").over(Window.partitionBy("bucket").orderBy("rn"))
    edited = combine(combine(F.col("own"), F.col("removed"), -1), F.col("inserted"))
    v = v.select("doc_id", "n_chars", "edited_sha256", "own", edited.alias("edited"), F.when(F.col("last"), F.col("after")).otherwise(follows).alias("next"))
    return v.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
