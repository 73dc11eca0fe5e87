import math
import zlib

import numpy as np
import pytest

from vecloom.llm import quality
from vecloom.session import sample_dir, table


def test_gradients():
    rng = np.random.default_rng(0)
    model = quality.Model(rng)
    x, bag, y = rng.normal(size=(9, quality.WIDTH)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0, 1])

    def loss():
        p = model.forward(x, bag, 3)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = model.gradients(model.forward(x, bag, 3), bag, y)
    for k, v in model.w.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_accuracy(spark):
    d = sample_dir("sf0.01")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 1.0), (None, "x", 2.0), (3, "word " * 50000, 3.0), (4, "A!! B!!", 4.0), (4, "A!! B!!", 4.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, None), (5, 1), (2, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert quality.reject_low_quality(docs, labels.limit(0)).count() == 6


def test_whole_text_counts():
    text = b"plain words here and there " * 200
    tail = text + b"ER!! ON!! TH!! " * 400
    assert len(quality.encode(tail)) > len(quality.encode(text)) and not np.array_equal(quality.encode(tail)[-1], quality.encode(text)[-1])


def plain_score(model, text):
    """One passage after the other, in plain Python."""
    w, x = model.w, (quality.encode(text) - model.mean) / model.scale
    hidden = [[math.tanh(sum(a * b for a, b in zip(row, w["enc"][:, j])) + w["enc_b"][j]) for j in range(quality.HIDDEN)] for row in x.tolist()]
    gates = []
    for h in hidden:
        t = [math.tanh(sum(a * b for a, b in zip(h, w["tan"][:, j]))) for j in range(quality.GATE)]
        s = [1 / (1 + math.exp(-sum(a * b for a, b in zip(h, w["sig"][:, j])))) for j in range(quality.GATE)]
        gates.append(math.exp(sum(a * b * c for a, b, c in zip(t, s, w["att"]))))
    z = [sum(g * h[j] for g, h in zip(gates, hidden)) / sum(gates) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, w["out"])) - w["out_b"][0]))


def test_matches_a_plain_forward_pass(spark):
    d = sample_dir("sf0.001")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in [*rows[:40], max(rows, key=lambda r: len(r.text or ""))]:
        want = plain_score(model, (r.text or "").encode())
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-5) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_repeats_crowd_no_label_out_and_all_passages_count(spark):
    train = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1][:20]
    docs = [(train[0], f"bad!! {k}") for k in range(500)] + [(k, ("plain words here " * 2000) if k % 2 else "#!! @@ !! " * 30) for k in train]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in train], "doc_id long, quality int")
    seen = []
    real = quality.Model.fit
    quality.Model.fit = lambda self, bags, y, rng: seen.append(bags) or real(self, bags, y, rng)
    try:
        quality.fit(df, labels)
    finally:
        quality.Model.fit = real
    assert len(seen[0]) == 20 and max(map(len, seen[0])) == -(-6000 // quality.PASSAGE_WORDS)


def test_driver_gives_the_fit_s_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(quality, "tidy", lambda: calls.append(1), raising=False)
    d = sample_dir("sf0.001")
    assert quality.fit(table(spark, d, "documents"), table(spark, d, "labels")) is not None and calls
