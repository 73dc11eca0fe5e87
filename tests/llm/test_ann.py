import numpy as np
import pytest

from vecloom.llm import ann
from vecloom.session import sample_dir, table


def brute(pairs, k=20, every=20):
    """Rankings by query id; a list of them, as rows may share an id."""
    ids = np.array([i for i, _ in pairs])
    lengths = np.array([len(v) for _, v in pairs])
    out = {}
    for i, (q, v) in enumerate(pairs):
        if q % every == 0:
            own = [j for j in np.flatnonzero(lengths == len(v)) if j != i]
            s = (np.array(v, float) * np.array([pairs[j][1] for j in own], float).reshape(len(own), len(v))).sum(1)
            order = np.lexsort((ids[own], -s))[:k]
            out.setdefault(q, []).append([(int(ids[own][j]), s[j]) for j in order])
    return {q: sorted(x) for q, x in out.items() if any(x)}


def rows(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_row, r.rank)):
        ranking = found.setdefault(r.query_id, {}).setdefault(r.query_row, [])
        ranking.append((r.vec_id, r.score))
        assert r.rank == len(ranking)
    return {q: sorted(x.values()) for q, x in found.items()}


@pytest.mark.parametrize("sampled", [ann.SAMPLE_ROWS, 500])
def test_recall_and_exact_scores(spark, monkeypatch, sampled):
    """Also where three quarters of the rows are unknown to the router."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", sampled)
    df = table(spark, sample_dir("sf0.1"), "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = rows(ann.nearest(df))
    assert got.keys() == want.keys() and all(len(x) == 20 for [x] in got.values())
    assert np.mean([len({i for i, _ in got[q][0]} & {i for i, _ in want[q][0]}) / 20 for q in want]) >= 0.9
    exact = {q: dict(x) for q, [x] in want.items()}
    assert all(s == exact[q][i] for q, [x] in got.items() for i, s in x if i in exact[q])


def test_fewer_parts_are_probed_where_vectors_have_clusters():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(32, 16)) * 4
    x = np.repeat(centre, 60, 0) + rng.normal(size=(1920, 16))
    assert ann.Router(rng.permutation(x)).probes <= 8


def test_probing_all_parts_is_exact_with_ties_odd_rows_and_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 200)]
    good += [(i, good[0][1]) for i in range(200, 400)]
    good += [(40, [9.0] * 8), (40, [9.0] * 8), (60, good[5][1])]
    good += [(1100, [1.0]), (1101, [-2.0]), (1102, [3.0]), (1120, [1.0] * 5)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] + [0.0] * 6), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (1140, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in good + odd], "vec_id long, embedding array<float>, part int, row int, d int, block int")
    want = brute(good)
    for values in (ann.BLOCK_VALUES, 80):
        monkeypatch.setattr(ann, "BLOCK_VALUES", values)
        assert rows(ann.nearest(df, target=1.0)) == want


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (21, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:4] for r in ann.nearest(df).collect()] == [(20, 1, 21, 11.0)]
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.limit(1)).collect() == []
