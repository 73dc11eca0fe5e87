import random
from collections import Counter

import numpy as np

from vecloom.llm import decontam
from vecloom.session import sample_dir, table


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], p + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 90)) for _ in range(2))
        item = decontam.Item(1, a, 5)
        assert decontam.common_subsequence(item.places, len(a), b.tolist()) == lcs(a.tolist(), b.tolist())
        assert decontam.common_subsequence(item.tail, item.tail_n, b.tolist()) == lcs(a[-item.tail_n :].tolist(), b.tolist()) or len(a) < 3


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 30)) * (rng.random((40, 30)) < 0.3)
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in a]
    v = decontam.latent_space(spark.createDataFrame(rows, "at array<int>, x array<double>").repartition(3), 30, rank=6, power=8)
    want = np.linalg.svd(a)[2][:6].T
    assert np.allclose(np.abs(np.linalg.svd(v.T @ want)[1]), 1, atol=1e-3)


def test_finds_every_verbatim_item_and_paraphrases(spark):
    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocab if rng.random() < 0.5 else vocab[:30]) for _ in range(n)]
    items = [text(n) for n in (5, 9, 16, 17, 33, 64, 65, 150, 400)] + [text(20) for _ in range(300)]
    docs, want = [], set()
    for k in range(400):
        words = text(rng.choice([0, 3, 40, 200, 2000]))
        if rng.random() < 0.5:
            i = rng.randrange(len(items))
            item = list(items[i])
            if rng.random() < 0.5:  # a paraphrase: some words replaced, moved or left out, its end kept
                for _ in range(len(item) // 8):
                    item[rng.randrange(max(1, len(item) * 3 // 4))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
            want.add((k, i))
        docs.append((k, ", ".join(w.title() for w in words), 1.0))
    docs += [(905, "It is QUITE, short!", 1.0), (906, "quite a short one", 1.0), (907, "phone quite", 1.0)]
    docs += [(900, None, 1.0), (901, "", 1.0), (None, " ".join(items[3]), 1.0), (902, " ".join(items[4]), 1.0), (902, " ".join(items[4]), 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, cosine double").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x), "s") for i, x in enumerate(items)] + [(1000, None, ""), (1001, "quite short", ""), (1002, "one", ""), (1003, "   ", ""), (None, "an item without any number here", "")], "item_id long, text string, cosine string")
    got = [(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()]
    assert got.count((902, 4)) == 2 and got.count((None, 3)) == 1
    assert {x for x in got if x[0] is not None and x[0] < 900} == want
    assert sorted(x for x in got if x[0] is not None and x[0] >= 905) == [(905, 1001), (906, 1002)]
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in want} - {902, 905, 906, None}


def test_verbatim_leaks_of_the_sample(spark):
    d = sample_dir("sf0.01")
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    norm = lambda t: " ".join(t.split())
    texts, items = [(r.doc_id, norm(r.text)) for r in docs.collect()], [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(i, j) for i, t in texts for j, x in items if x in t}
    got = {(r.doc_id, r.item_id): r.lcs_share for r in decontam.leaks(docs, bench).collect()}
    assert want and want <= set(got) and len(set(got) - want) <= len(want) // 10


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.leaks(docs, bench.limit(0)).collect() == [] and decontam.leaks(docs.limit(0), bench).collect() == []
    assert decontam.without_leaks(docs, bench.limit(0)).count() == 1 and decontam.without_leaks(docs, bench).count() == 0


def judged(item, text):
    """The rule itself, by plain dynamic programming over every stretch of a text."""
    n, step = len(item), max(1, len(item) // 8)
    length, tail = n + n // 4 + step, min(max(3, n // 5), n)
    for a in range(0, max(1, len(text) - length + step), step):
        part = text[a : a + length]
        if sum((Counter(part) & Counter(item)).values()) >= 0.65 * n:
            got = lcs(item, part)
            if got >= 0.8 * n or got >= 0.65 * n and lcs(item[-tail:], part) >= 0.8 * tail:
                return True
    return False


def test_all_pairs_by_the_rule_at_several_lengths(spark):
    """Every document against every item by the rule alone: no leak is lost to the latent search, none is made up."""
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(2000)]
    word = lambda: rng.choice(vocab if rng.random() < 0.6 else vocab[:30])
    items = [[word() for _ in range(n)] for n in (8, 16, 32, 64, 96, 128, 200) for _ in range(6)]
    docs = []
    for k in range(170):
        words = [word() for _ in range(rng.choice([0, 20, 150, 500]))]
        if k % 5:
            item = list(rng.choice(items))
            for _ in range(int(len(item) * rng.choice([0, 0.05, 0.1, 0.2, 0.3, 0.45]))):
                at = rng.randrange(len(item))
                rng.choice([lambda: item.pop(at), lambda: item.insert(at, word()), lambda: item.__setitem__(at, word())])()
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append(words)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if judged(item, text)}
    by_length = {n: (len({x for x in want & got if len(items[x[1]]) == n}), len({x for x in want if len(items[x[1]]) == n})) for n in (8, 16, 32, 64, 96, 128, 200)}
    print(by_length, len(got - want))
    assert all(total and found >= 0.95 * total for found, total in by_length.values()), by_length
    assert len(got - want) <= 0.05 * len(want)
