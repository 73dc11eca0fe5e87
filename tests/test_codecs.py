import numpy as np
import pytest

from vecloom.functions import vectors as V
from vecloom.functions.vectors import Metric, VectorError, score_blocks
from vecloom.operators import codecs
from vecloom.operators.codecs import codec_by_name


def corpus(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    x = centre[np.arange(n) % 8] + 0.3 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


NAMES = ["f32", "int8", "binary", "binary-centred", "binary-hamming", "pq", "pq8", "mrl8", "mrl16+int8", "mrl8+binary", "mixed", "mixed8-w", "mixed4-pca", "mixed8-pca-w"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("dim", [32, 64])
def test_scores_sizes_and_params(name, dim):
    x = corpus(300, dim)
    codec = codec_by_name(name, dim)
    if codec.trained:
        with pytest.raises(codecs.NotFitted):
            codec.encode(x)
    codec.fit(x)
    codes = codec.encode(x)
    blobs = codec.pack(codes)
    assert all(len(b) == codec.size for b in blobs) and codec.compression_ratio == 4 * dim / codec.size
    again = codec_by_name(name, dim).restore(codec.params())
    assert np.array_equal(again.encode(x), codes)
    back = codec.unpack(blobs)
    for metric in Metric:
        s = codec.scores(x[:5], codes, metric)
        assert np.allclose(s, again.scores(x[:5], back, metric), atol=1e-9)
        if name != "binary-hamming" and not name.startswith("mrl"):
            assert np.allclose(s, score_blocks(x[:5], codec.decode(codes), metric), atol=1e-4 * (1 + np.abs(s).max()))
    with pytest.raises(VectorError):
        codec.encode(x[:, :-1])
    with pytest.raises(VectorError):
        codec.unpack([b"x" * (codec.size + 1)])
    with pytest.raises(VectorError):
        codec_by_name(name, dim).restore(codec.params() + b"xyz")


def test_columns_agree_with_numpy(spark):
    x = corpus(60, 70)
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "id int, v array<float>")
    x = x.astype(np.float32).astype(float)
    for name in ("f32", "int8", "binary", "binary-centred", "mixed10", "mixed10-w", "mrl10+int8"):
        codec = codec_by_name(name, 70).fit(x)
        rows = df.select("id", codec.decode_col(codec.encode_col(df["v"])).alias("w")).orderBy("id").collect()
        assert np.allclose(np.array([r.w for r in rows]), codec.decode(codec.encode(x)), atol=1e-6), name
    h = codec_by_name("binary-hamming", 70)
    rows = df.alias("a").crossJoin(df.alias("b")).selectExpr("a.id i", "b.id j", "a.v x", "b.v y")
    got = rows.select("i", "j", h.score_col(h.encode_col(rows["x"]), h.encode_col(rows["y"]), Metric.COSINE).alias("s")).orderBy("i", "j").collect()
    assert np.allclose(np.array([r.s for r in got]).reshape(60, 60), h.scores(x, h.encode(x), Metric.COSINE))


def test_known_sizes_and_values():
    assert [codec_by_name(n, 384).size for n in ("f32", "int8", "binary")] == [1536, 392, 48]
    assert codecs.allocate([16, 4, 1, 0], 6).sum() == 6 and codecs.allocate([1, 1], 100).tolist() == [8, 8]
    c = codec_by_name("int8", 4)
    assert np.array_equal(c.decode(c.encode(np.full((1, 4), 0.5))), np.full((1, 4), 0.5))
    assert codecs.PQ(8, 2).fit(corpus(6, 8)).centroids.shape == (2, 6, 4)
    worst = np.abs(c.decode(c.encode(np.array([[0, 0.3, 0.7, 1.0]]))) - [[0, 0.3, 0.7, 1.0]]).max()
    assert worst <= 0.5 / 255 + 1e-6


def greedy(variance, bits):
    out = np.zeros(len(variance), int)
    for _ in range(bits):
        gain = np.where(out < 8, np.array(variance, float) / 4.0**out, -1)
        if gain.max() < 0:
            break
        out[gain.argmax()] += 1
    return out


def test_allocation_is_the_greedy_one():
    rng = np.random.default_rng(3)
    for _ in range(300):
        v = rng.choice([0, 1, 4, 16, 0.5, rng.random()], rng.integers(1, 12))
        n = int(rng.integers(0, 8 * len(v) + 3))
        assert codecs.allocate(v, n).tolist() == greedy(v, n).tolist()


@pytest.mark.parametrize("name", ["nope", "pq7", "pq0", "mrl", "mrl0", "mrl65", "mrl8+nope", "mixed0", "mixed65", "mixed8-w-pca", "int8x", "binary-"])
def test_refused_names(name):
    with pytest.raises(VectorError):
        codec_by_name(name, 64)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.dot(df.a, df.b).alias("d"), V.cosine(df.a, df.b).alias("c"), V.l2_squared(df.a, df.b).alias("l"), V.norm(df.a).alias("n"), V.normalize(df.b).alias("u")).collect()
    assert (r[0].d, r[0].c, r[0].l, r[0].n, r[0].u) == (0, 0, 25, 5, [0, 0]) and r[1].c == pytest.approx(0.8)
    assert Metric.parse(" L2 ") is Metric.L2 and not Metric.L2.higher_is_better
    with pytest.raises(VectorError):
        Metric.parse("hamming")


@pytest.mark.parametrize("name", ["pq8", "mrl32+binary-centred", "mrl32+pq4", "mixed8", "mixed8-w", "mrl32+mixed4"])
def test_fit_takes_every_vector(spark, monkeypatch, name):
    monkeypatch.setattr(codecs, "FIT_VECTORS", 50)
    x = corpus(600, 64, seed=3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got, want = codecs.fit_codec(name, df, 64), codec_by_name(name, 64).fit(x)
    assert len(got.params()) == len(want.params())
    assert np.allclose(got.decode(got.encode(x)), want.decode(want.encode(x)), atol=1e-5)
