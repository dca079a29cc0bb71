import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
from compare import DATA

from tidewatch.llm import substring as s
from tidewatch.llm.common import shared_dir

RNG = random.Random(9)


def prose(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n)]


def units(texts, lines=True):
    return s._units(texts, s.LEAST, s.tune_bands(), lines)


def test_bands():
    for similarity in (0.5, 0.8, 0.95):
        n = s.tune_bands(similarity)
        assert (1 - similarity**s.ROWS) ** n <= 0.001 < (1 - similarity**s.ROWS) ** (n - 1)


def test_repeated_windows_are_found(spark):
    """Every document that shares 50 words in a row with another has a row."""
    d = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower()) for r in d.collect()}
    owners = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            owners[hash(tuple(w[k : k + 50]))].add(i)
    shared = {i for o in owners.values() if len(o) > 1 for i in o}
    assert shared <= {r["doc_id"] for r in s.op10(d).collect()}


def test_fifty_shared_words_are_never_missed():
    for seed in range(300):
        rng = random.Random(seed)
        passage = prose(50, seed)
        cut = rng.randrange(1, 49)
        broken = [*passage[:cut], passage[cut] + "\n"]
        a, b = prose(rng.randrange(120), 1000 + seed) + passage + prose(rng.randrange(120), 2000 + seed), prose(rng.randrange(120), 3000 + seed) + broken + passage[cut + 1 :] + prose(rng.randrange(120), 4000 + seed)
        text, line, word, words, d1, d2, bands = units([" ".join(a).encode(), b"", " ".join(b).encode()])
        of = lambda k: set(zip(d1[~line & (text == k)].tolist(), d2[~line & (text == k)].tolist()))
        assert of(0) & of(2)


def test_sections_lose_nothing(spark, monkeypatch):
    """A long text in parts has all the kept passages and lines of the whole."""
    text = "\n".join(" ".join(prose(RNG.randrange(5, 90), i)) for i in range(300)).encode()
    whole = units([text])
    got, lines = set(), set()
    for before, repeated, complete, part in s._sections(text, 3000):
        assert complete
        _, line, word, words, d1, d2, _ = units([part])
        got |= set(zip((word + before)[~line].tolist(), d1[~line].tolist(), d2[~line].tolist()))
        lines |= set(zip((word + before)[line & (word >= repeated)].tolist(), d1[line & (word >= repeated)].tolist()))
    line, word, d1, d2 = whole[1], whole[2], whole[4], whole[5]
    assert set(zip(word[~line].tolist(), d1[~line].tolist(), d2[~line].tolist())) <= got
    assert set(zip(word[line].tolist(), d1[line].tolist())) == lines


def test_planted_passages(spark):
    """55 words inside one long line of each of three documents; clean
    documents stay out."""
    passage = prose(55, 1)
    rows = [(i, " ".join(prose(150, 100 + i) + passage + prose(120, 200 + i))) for i in range(3)] + [(i, " ".join(prose(300, 300 + i))) for i in range(3, 40)]
    got = s.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2}
    assert sum(not r["removed"] for r in got) >= 1 and {r["doc_id"] for r in got if r["removed"]} == {1, 2}
    assert all(r["word"] + r["words"] > 150 and r["word"] < 205 for r in got)


def near(words, k, seed):
    rng = random.Random(seed)
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"changed{seed}x{i}"
    return out


def jaccard(a, b):
    f = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return len(f(a) & f(b)) / len(f(a) | f(b))


def test_near_paragraphs_like_brute_force(spark):
    base = [prose(200, i) for i in range(12)]
    texts = [w for i, b in enumerate(base) for w in (b, near(b, 2, 50 + i), near(b, 4, 70 + i), near(b, 40, 90 + i))]
    d = spark.createDataFrame([(i, "Intro line.\n" + " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    parent = list(range(len(texts)))
    for _ in range(4):
        for i in range(len(texts)):
            for j in range(i):
                if jaccard(texts[i], texts[j]) >= 0.8:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    want = {(i, parent[i]) for i in range(len(texts)) if parent.count(parent[i]) > 1}
    assert {(r["doc_id"], r["class_id"]) for r in s.op10(d).collect() if r["near"]} == want


def test_a_large_group_of_near_copies(spark):
    base = prose(100, 5)
    rows = [(i, " ".join(near(base, 1, i))) for i in range(400)]
    got = [r for r in s.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["near"]]
    assert len(got) == 400 and {r["class_id"] for r in got} == {0} and sum(not r["removed"] for r in got) == 1


def test_odd_rows(odd, clashing, nothing):
    got = s.op10(odd).collect()
    assert {r["doc_id"] for r in got if r["near"]} >= {1, 2, 9} and None not in {r["doc_id"] for r in got}
    assert {r["doc_id"] for r in got if r["near"] and not r["removed"]} >= {1}
    assert sorted(map(str, s.op10(clashing).collect())) == sorted(map(str, got))
    assert s.op10(nothing).count() == 0


def test_a_passage_in_the_first_of_some_paragraphs(spark):
    """A paragraph that stays, as the first of its class, still shows that it
    repeats an earlier document's passage."""
    passage, shared = prose(60, 1), prose(40, 2)
    b = " ".join(shared + passage + prose(40, 3))
    rows = [(0, " ".join(prose(80, 4) + passage + prose(80, 5))), (5, "\n".join([" ".join(prose(30, 6)), b])), (9, "\n".join([b, " ".join(prose(30, 7))]))]
    got = s.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["removed"]) for r in got if r["near"]} == {(5, False), (9, True)}
    assert any(r["doc_id"] == 5 and r["removed"] and r["word"] < 130 and r["word"] + r["words"] > 70 for r in got)


def test_shared_stretches_are_spanned_in_full(spark):
    """Rows cover every word of 50 or more that documents share, and no
    others."""
    sizes = [50, 55, 70, 100, 200, 400]
    passages = [prose(n, 9000 + n) for n in sizes]
    rows = [(10 * k + j, " ".join(prose(30 + 17 * j + k, 500 + 10 * k + j) + p + prose(41, 600 + 10 * k + j))) for k, p in enumerate(passages) for j in (0, 1)]
    got = s.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(10 * k + j, 30 + 17 * j + k, n) for k, n in enumerate(sizes) for j in (0, 1)}
    assert {(r["doc_id"], r["word"], r["words"]) for r in got} == want
    assert all(r["class_id"] == r["doc_id"] // 10 * 10 and r["class_word"] == 30 + r["class_id"] // 10 and r["removed"] == (r["doc_id"] % 10 == 1) for r in got)


def test_runs_keep_each_first_document(spark):
    """A document that shares words with an earlier one and, overlapping them,
    words with a later one: a row for each, and one first copy stays."""
    shared = prose(175, 8001)
    rows = [(1, " ".join(prose(40, 8002) + shared[:100])), (2, " ".join(shared + prose(60, 8003))), (3, " ".join(prose(50, 8004) + shared[75:]))]
    got = {(r["doc_id"], r["word"], r["words"], r["class_id"], r["class_word"], r["removed"]) for r in s.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {(1, 40, 100, 1, 40, False), (2, 81, 94, 2, 81, False)}
    assert got == first | {(2, 0, 100, 1, 40, True), (3, 50, 25, 1, 115, True), (3, 56, 94, 2, 81, True)}


def test_long_lines_count_as_one_wherever_they_stand():
    """A line that is read in parts has the digest and bands of the whole line."""
    long, short = " ".join(prose(2_000, 77)), " ".join(prose(30, 78))
    want = units([long.encode()])
    for before in ("", short + "\n", short + "\n\n" + short + " x\n"):
        text = (before + long + "\n" + short).encode()
        (word, n, d1, d2, bands), = s._long_lines(text, s.LEAST, s.tune_bands(), 1_000)
        assert word == len(before.split()) and n == 2_000
        assert (d1[0], d2[0]) == (want[4][0], want[5][0]) and (bands == want[6]).all()
        parts = list(s._sections(text, 1_000))
        assert any(not whole for *_, whole, _ in parts)
        lines, kept = set(), set()
        for at, repeated, whole, part in parts:
            _, line, w, words, d1, _, _ = units([part], whole)
            lines |= {x + at for x in w[line & (w >= repeated)].tolist()}
            kept |= set(d1[~line].tolist())
        at, want_lines = 0, set()
        for x in (before + long + "\n" + short).split("\n"):
            want_lines |= {at} if 20 <= len(x.split()) < 2_000 else set()
            at += len(x.split())
        assert lines == want_lines
        assert set(want[4][~want[1]].tolist()) <= kept


def test_rare_prefixes_lose_no_similar_pair(spark):
    rng = random.Random(4)
    common = list(range(40))
    sets = [sorted(rng.sample(common, rng.randint(20, 40)) + [1000 + rng.randrange(60) for _ in range(rng.randint(0, 6))]) for _ in range(120)]
    sets = [sorted(set(x)) for x in sets]
    d = spark.createDataFrame(list(enumerate(sets)), "p long, shingles array<long>")
    prefix = {r["p"]: set(r["prefix"]) for r in s.rare_prefixes(d, 0.8).collect()}
    pairs = [(i, j) for i in range(120) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
    assert pairs and all(prefix[i] & prefix[j] for i, j in pairs)


def test_a_family_of_like_paragraphs(spark):
    """Paragraphs of one template, under the similarity, and a few copies among
    them: only the copies are linked."""
    frame = prose(60, 11)
    rows = []
    for i in range(200):
        w = list(frame)
        for k in range(8):
            w[7 * k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1].replace(f"own{i}x3", "other")) for i in range(0, 200, 10)]
    got = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.7).where("near").collect()
    words = {i: t.split() for i, t in rows}
    want = {i for i, _ in rows if any(i != j and jaccard(words[i], words[j]) >= 0.7 for j, _ in rows)}
    assert {r["doc_id"] for r in got} == want and all(r["class_id"] == r["doc_id"] % 1000 for r in got)


def test_recall_of_near_paragraphs_on_documents(spark):
    """Every pair of paragraphs of similarity 0.8 or more of the table, by brute
    force over an inverted index of rare shingles."""
    d = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    lines = {}
    for r in d.where("text is not null").collect():
        at = 0
        for line in r["text"].split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
            if len(w) >= 20:
                lines[r["doc_id"], at] = w
            at += len(w)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in lines.items()}
    index = defaultdict(list)
    for k, x in sets.items():
        for t in x:
            index[t].append(k)
    linked = set()
    seen = set()
    for k, x in sets.items():
        rarest = sorted(x, key=lambda t: (len(index[t]), t))[: len(x) - -(-8 * len(x) // 10) + 1]
        for j in {j for t in rarest for j in index[t]}:
            if j < k and (j, k) not in seen:
                seen.add((j, k))
                if len(sets[j] & x) >= 0.8 * len(sets[j] | x):
                    linked |= {j, k}
    got = {(r["doc_id"], r["word"]) for r in s.op10(d).where("near").collect()}
    assert linked and len(linked & got) >= 0.99 * len(linked) and got <= linked


def test_keys_of_any_type_and_no_key(spark):
    line = " ".join(prose(40, 31))
    d = spark.createDataFrame([("b", line), ("a", "x\n" + line), (None, line + "\ny"), ("a", line), ("a", line), ("c", None), ("d", "")], "doc_id string, text string")
    got = s.op10(d).collect()
    assert sorted((str(r["doc_id"]), r["removed"]) for r in got) == [("None", False), ("a", True), ("a", True), ("b", True)]
    assert all(r["class_id"] is None for r in got)


def test_which_passages_are_compared_again():
    for seed in range(300):
        rng = random.Random(seed)
        hits = sorted(rng.sample(range(400), rng.randint(1, 25)))
        chains = [rng.randint(0, 1) for _ in hits]
        want = set()
        for w in range(500):
            if w in hits or min(abs(w - h) for h in hits) >= s.WINDOW:
                continue
            k = sum(h < w for h in hits)
            if 0 < k < len(hits) and hits[k] - hits[k - 1] <= s.WINDOW and chains[k] == chains[k - 1]:
                a, b = hits[k - 1], hits[k]
                if min(w - a, b - w) > b - a - s.PASSAGE:
                    continue
            want.add(w)
        assert set(s._beside(np.array(hits), np.array(chains)).tolist()) == want
        # every word of a chain is spanned, if all that are compared repeat
        spanned = {x + i for x in [*hits, *want] for i in range(s.PASSAGE)}
        for a, b, x, y in zip(hits, hits[1:], chains, chains[1:]):
            if x == y and b - a <= s.WINDOW:
                assert spanned >= set(range(a, b + s.PASSAGE))


def test_random_shared_stretches_by_brute_force(spark):
    """Documents of overlapping parts of common texts: every word of a stretch of
    50 or more that another document shares is spanned, and no other."""
    rng = random.Random(12)
    pool = [prose(300, 700 + i) for i in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(250)
            w += p[a : a + rng.randint(10, 150)] + prose(rng.randint(3, 60), 10_000 + 10 * i + len(w))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"odd{i}"
        docs.append(w)
    count = defaultdict(int)
    for w in docs:
        for k in range(len(w) - 19):
            count[tuple(w[k : k + 20])] += 1
    want = set()
    for i, w in enumerate(docs):
        hit = [count[tuple(w[k : k + 20])] > 1 for k in range(len(w) - 19)]
        covered = sorted({k + j for k, h in enumerate(hit) if h for j in range(20)})
        runs = []
        for x in covered:
            if runs and runs[-1][-1] == x - 1:
                runs[-1].append(x)
            else:
                runs.append([x])
        want |= {(i, x) for r in runs if len(r) >= 50 for x in r}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    rows = s.op10(d).collect()
    got = {(r["doc_id"], r["word"] + j) for r in rows for j in range(r["words"])}
    # in stretches that another document shares in a row, all; runs that are
    # patched together from shorter parts may be found in part
    exact = set()
    for i, w in enumerate(docs):
        grams = {tuple(w[k : k + 50]): k for k in range(len(w) - 49)}
        for j, v in enumerate(docs):
            if i != j:
                for k in range(len(v) - 49):
                    if (at := grams.get(tuple(v[k : k + 50]))) is not None:
                        exact |= {(i, at + x) for x in range(50)}
    assert exact <= got <= want and len(got) > 1000


def test_finished_steps_leave_no_tables(spark):
    """The large tables between steps are deleted once what is read from them is
    written, so the shared folder holds a part of them at any time."""
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.iterdir())
    line = " ".join(prose(60, 41))
    rows = [(i, " ".join(prose(30, 800 + i)) + "\n" + line) for i in range(3)]
    got = s.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["removed"]) for r in got} == {(0, False), (1, True), (2, True)}
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "substring-paragraphs" in left
    assert not left & {"substring-units", "substring-hits", "substring-texts", "substring-classes", "substring-lines", "substring-sets"}


def test_texts_are_numbered_in_order(spark):
    texts = spark.createDataFrame([("b", 1), (None, 2), ("a", 7), ("a", -3), ("c", 0)], "id string, th long").repartition(3)
    got = sorted((r["n"], r["id"], r["th"]) for r in s._numbered(texts).collect())
    assert got == [(0, None, 2), (1, "a", -3), (2, "a", 7), (3, "b", 1), (4, "c", 0)]
