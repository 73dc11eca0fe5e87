import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import minhash


def bag(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0


def classes(rows, threshold=0.8):
    bags = [(i, bag(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if similar(a, b) >= threshold:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, find(i) if i is not None else None) for i, _ in rows), key=str)


def make(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["é", "日本"]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    rows, k = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (4, "a b c"), (5, "a\tb  c"), (6, "a b"), (7, "x " * 400), (8, "x " * 380), (9, "x " * 100), (4, "a b c")], 10
    for _ in range(n):
        base = text(rng.randrange(5, 150))
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(int(len(words) * rng.choice([0, 0.01, 0.02, 0.04, 0.1]))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((k, " ".join(words)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for _ in range(6):
        g = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        g.sort()
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        grams, counts, of = np.concatenate([g[a > 0], g[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = minhash.signatures(grams, counts, of, 2, size=4000)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 4000) ** 0.5 + 0.002


def test_profiles_never_rule_out_similar_bags():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 5, 40), rng.integers(0, 5, 40)
        same = rng.random(40) < 0.9
        a[same] = b[same]
        slot = rng.integers(0, 7, 40)
        pa_, pb = (np.bincount(slot, weights=x, minlength=7).astype(np.uint16) for x in (a, b))
        if np.minimum(a, b).sum() >= 0.8 * np.maximum(a, b).sum():
            assert minhash._possible(pa_, pb[None], a.sum(), np.array([b.sum()]), 0.8)[0]


def test_matches_all_pairs(spark):
    rows = make()
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, bands string").repartition(4)
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == classes(rows)
    first = {i for i, c in classes(rows) if i == c}
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == first | {None}


def test_large_groups_lose_no_link(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("DIVIDED", 12), ("BLOCK", 5)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(40):  # one passage makes most of each document: many share bands, few are similar
        tail = [f"t{rng.randrange(12)}x{j}" for j in range(rng.randrange(8, 22))]
        rows.append((k, " ".join(common + tail)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()), key=str) == classes(rows)


def test_large_group_of_one_band_loses_no_link(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("DIVIDED", 12), ("BLOCK", 5)):
        monkeypatch.setattr(minhash, name, value)
    signed = minhash._signed
    monkeypatch.setattr(minhash, "_signed", lambda *a: signed(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))  # the only band all share
    rng = random.Random(6)
    rows = []
    for k in range(20):
        words = [f"f{k}x{j}" for j in range(rng.randrange(40, 90))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-2] + ["a", "b"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()), key=str) == classes(rows)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
