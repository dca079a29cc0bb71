from zlib import crc32

import numpy as np
from compare import DATA

from tidewatch.llm import milquality as q


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()) if len(a) and len(b) else 1.0


def test_held_out_auc(spark):
    sf = str(DATA / "sf0.01")
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in l.collect()}
    rows = q.op7(d, l).collect()
    assert len(rows) == d.count()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [(r["score"], quality[r["doc_id"]]) for r in rows if r["held_out"] and quality.get(r["doc_id"]) is not None]
    assert auc(*zip(*out)) >= 0.9


def test_held_out_labels_are_not_used(documents, labels):
    held = q.held_out(labels["doc_id"], 3, 1, False)
    other = labels.withColumn("quality", q.F.when(held, 1 - labels["quality"]).otherwise(labels["quality"]))
    assert sorted(map(str, q.op7(documents, other).collect())) == sorted(map(str, q.op7(documents, labels).collect()))


def test_it_learns_which_passage_decides():
    rng = np.random.default_rng(0)
    x, starts, y = rng.random((40, 6), np.float32), np.arange(0, 40, 4), (np.arange(10) % 2).astype(np.float32)
    x[y.repeat(4) == 1, 0] += 0.5
    m = q.fit(x, starts, y, rounds=200)
    p = m.forward(x, starts)["p"]
    assert ((p > 0.5) == (y == 1)).mean() >= 0.9


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, starts, y = rng.random((23, 5)), np.array([0, 4, 5, 11, 20]), np.array([1.0, 0, 1, 1, 0])
    w = {"w0": rng.standard_normal((5, 4)), "b0": rng.standard_normal(4), "v": rng.standard_normal((4, 3)), "u": rng.standard_normal((4, 3)), "w": rng.standard_normal(3), "c": rng.standard_normal(4), "b": np.zeros(1)}
    m = q.Model(x.mean(0), x.std(0), w)

    def loss():
        p = m.forward(x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    got = q.gradient(m, x, starts, y)
    for name, values in w.items():
        for i in np.ndindex(values.shape):
            kept, values[i] = values[i], values[i] + 1e-5
            up = loss()
            values[i] = kept - 1e-5
            down = loss()
            values[i] = kept
            assert abs(got[name][i] - (up - down) / 2e-5) < 1e-6, (name, i)


def test_a_long_text_is_encoded_like_a_short_one(monkeypatch):
    text = b"  " + b" ".join(b"w%d,\n" % (i % 91) for i in range(6_000)) + b" \t "
    want = q.encode_passages([text])
    monkeypatch.setattr(q, "LONG", 4096)
    for size in (100, 2048, 5000):
        parts = list(q._whole_passages(text.strip(), size))
        assert b"".join(p[1:] for p in parts) == text.strip() + b" " and all(len(p[1:].split()) % q.PASSAGE == 0 for p in parts[:-1])
    own, x = q.encode_passages([text])
    assert len(x) == len(want[1]) == -(-6_000 // q.PASSAGE) and (x == want[1]).all()
    assert q.encode_passages([b" " * 5000])[1].shape == (1, q.WIDTH)
    assert q.encode_passages([b"x" * 50_000])[1].shape == (1, q.WIDTH)


def test_bytes_bound_the_sample_by_rows(documents, labels):
    small = q.train(documents, labels, most_bytes=100_000)
    assert small.w["w0"].shape == (q.WIDTH, 24)


def test_passages():
    own, x = q.encode_passages([b"", b"a b c", b" ".join([b"w"] * 130), None])
    assert own.tolist() == [0, 1, 2, 2, 2, 3] and x.shape == (6, q.WIDTH)
    assert not x[0].any() and not x[5].any()


def test_odd_rows(spark, odd, clashing, nothing):
    l = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 0, 0), (8, 0, None), (None, 1, 1), (12, None, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    rows = q.op7(odd, l).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert q.op7(odd, l.limit(0)).count() == len(rows)
    assert q.op7(nothing, l).count() == 0
    model = q.train(clashing, l)
    got = q.score(clashing, model).collect()
    assert len(got) == len(rows) and all(r["size"] == "kept size" for r in got)
