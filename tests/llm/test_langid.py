from math import log
from zlib import crc32

import numpy as np
import pytest
from compare import DATA

from tidewatch.llm import langid


def test_held_out_accuracy(spark):
    d = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    lang = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    rows = langid.op3(d).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and lang[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) >= 0.97


def test_nothing_is_learned_from_held_out_rows(spark, documents):
    held = langid.held_out(documents["doc_id"], 5, 0, False)
    wrong = documents.withColumn("lang", langid.F.when(held, langid.F.lit("xx")).otherwise(documents["lang"]))
    assert sorted(map(str, langid.op3(wrong).collect())) == sorted(map(str, langid.op3(documents).collect()))


def test_mixture_of_two_languages(spark, documents):
    d = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    model = langid.fitted(d)
    text = {}
    for r in d.where("length(text) > 1500").orderBy("doc_id").collect():
        text.setdefault(r["lang"], r["text"])
    got = model.infer([(text["en"][:1500] + " " + text["de"][:1500]).encode(), text["en"][:1500].encode()])
    assert {x for x, _ in got[0][2]} == {"en", "de"} and all(s > 0.25 for _, s in got[0][2])
    assert [x for x, _ in got[1][2]] == ["en"]


def test_pieces_of_a_long_text_count_like_the_whole():
    text = b"some words of a text " * 500
    a, b = langid.bags([text], piece=1000), langid.bags([text, b""])
    assert (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_odd_rows(odd, clashing, nothing):
    rows = langid.op3(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (3, 4, 5, 6))
    assert by[1]["lang_pred"] != "und" and all(r["held_out"] for r in rows if r["doc_id"] is None)
    out = langid.identified_documents(clashing)
    assert out.schema == clashing.schema and {r["doc_id"] for r in out.collect()} >= {1, 2, 7, 9}
    assert langid.op3(nothing).count() == 0 and langid.identified_documents(nothing).count() == 0


def toy(languages):
    """Languages that each like their own letters."""
    rng = np.random.default_rng(3)
    p = rng.random((langid.BUCKETS, languages)) * 0.2
    for k in range(languages):
        a = np.frombuffer(b" " + bytes([97 + 3 * k, 98 + 3 * k, 99 + 3 * k]) * 400 + b" ", np.uint8)
        p[langid.gram_buckets(a)[1], k] += 400
    return langid.Model([f"l{k}" for k in range(languages)], (p / p.sum(0) * langid.BUCKETS).astype(np.float32))


def words(k, n):
    return b" ".join([bytes([97 + 3 * k, 98 + 3 * k, 99 + 3 * k]) * 3] * n)


def test_em_by_brute_force():
    model = toy(3)
    texts = [words(0, 30) + b" " + words(2, 10), words(1, 5), b"zzz yyy " + words(1, 40) + b" " + words(0, 13)]
    which, bucket, count = langid.bags(texts)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    share, ll = model.em(model.p[bucket], count.astype(np.float32), first, np.full((3, 3), 1 / 3))
    for d in range(3):
        grams = [(model.p[b].astype(float), int(c)) for w, b, c in zip(which, bucket, count) if w == d]
        s = [1 / 3] * 3
        for _ in range(langid.ROUNDS):
            r = [0.0] * 3
            for p, c in grams:
                total = sum(x * y for x, y in zip(p, s))
                r = [a + c * x * y / total for a, x, y in zip(r, p, s)]
            new = [x / sum(r) for x in r]
            still = max(abs(x - y) for x, y in zip(new, s)) <= langid.STILL
            s = new
            if still:
                break
        assert share[d] == pytest.approx(s, abs=1e-3)
        assert ll[d] == pytest.approx(sum(c * log(sum(x * y for x, y in zip(p, s))) for p, c in grams), rel=1e-3)


def test_six_languages_in_one_text_and_neighbours_dont_count():
    model = toy(6)
    text = b" ".join(words(k, 60) for k in range(6))
    alone = model.infer([text])[0]
    assert {x for x, _ in alone[2]} == set(model.languages) and alone[1] < 0.4
    again = model.infer([words(0, 9), text, words(3, 40) + words(4, 50)])[1]
    assert again[0] == alone[0] and again[1] == pytest.approx(alone[1]) and again[3] == pytest.approx(alone[3], rel=1e-5)


def test_sets_by_brute_force():
    """The chosen set is the best prefix of the ranking, by the penalised likelihood."""
    model = toy(4)
    for text in (words(0, 80), words(0, 80) + b" " + words(1, 60), words(2, 30) + b" " + words(0, 40) + b" " + words(3, 50), words(1, 2)):
        which, bucket, count = langid.bags([text])
        c, p = count.astype(np.float32), model.p[bucket]
        share, _ = model.em(p, c, np.array([0]), np.full((1, 4), 1 / 4))
        best = (c[:, None] * np.log(p)).sum(0).argmax()
        order = np.argsort(-(share[0] + 2.0 * (np.arange(4) == best)), kind="stable")
        penalty = (0.5 * log(c.sum() + 1) + 4) * langid.SHARE_OF_GRAMS
        value = []
        for k in range(1, 5):
            inside = np.zeros((1, 4))
            inside[0, order[:k]] = 1 / k
            value.append(model.em(p, c, np.array([0]), inside)[1][0] - penalty * (k - 1))
        k = int(np.argmax(value)) + 1
        assert {x for x, _ in model.infer([text])[0][2]} == {model.languages[i] for i in order[:k]}


UNSEEN = ["ok", "日本語のテキストです。", "Русский текст о погоде и море", "lorem ipsum dolor sit amet"]


def test_a_rare_label_doesnt_take_unseen_text(spark):
    """One row of a fifth language: it changes nothing for other texts, and its
    own words are still its own."""
    d = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    rare = d.limit(1).withColumns({"doc_id": langid.F.lit(1).cast("long"), "text": langid.F.lit("hello my name is"), "lang": langid.F.lit("xx")})
    learned = d.where(~langid.held_out(d["doc_id"], 5, 0, False)).unionByName(rare)
    model = langid.train(learned)
    assert "xx" in model.languages
    got = model.infer([t.lower().encode() for t in UNSEEN])
    assert all(g[0] != "xx" for g in got)
    assert all(g[1] < 0.05 for g in got[1:3])
    assert model.infer([b"hello my name is"])[0][0] == "xx"
    docs = {r["lang"]: r["text"] for r in d.where("lang IS NOT NULL AND length(text) > 300").collect()}
    for lang, text in docs.items():
        name, score, _, _ = model.infer([text.lower().encode()])[0]
        assert name == lang and score > 0.5


def test_scores_know_chance():
    model = toy(3)
    sure, other = model.infer([words(1, 40), b"xyz xyz zyx"])
    assert sure[1] > 0.99 and other[1] < 0.5 and other[3] < sure[3]


def test_unseen_grams_are_alike_in_all_languages():
    counts = np.zeros((langid.BUCKETS, 3))
    counts[:50, 0], counts[40:90, 1], counts[7, 2] = 1000, 3, 1
    p = langid.smoothed(counts, 0.05)
    assert np.allclose(p.sum(0, dtype=float), langid.BUCKETS, rtol=1e-4) and np.allclose(p[200], p[200, 0])
