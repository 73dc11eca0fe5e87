import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import katz, store


def brute(rows, order):
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    docs = [tokens(t) for _, t in rows]
    grams = [Counter() for _ in range(order)]
    for d, out in zip(docs, held):
        if not out:
            grams[0].update((w,) for w in d)
            for n in range(2, order + 1):
                padded = ["<begin>", *d]
                grams[n - 1].update(tuple(padded[k : k + n]) for k in range(len(padded) - n + 1))
    one = Counter({w: c for (w,), c in grams[0].items()})
    n, v = sum(one.values()), len(one)
    ds = [katz.discounts([sum(c == r for c in x.values()) for r in range(1, katz.K + 2)]) for x in grams]
    cut = lambda d, r: (d[r - 1] if r <= katz.K else 1) * r
    p1 = {w: cut(ds[0], c) / (n + 1) for w, c in one.items()}
    unk = 1 - math.fsum(p1.values())
    follow = {}
    for x in grams[1:]:
        for g, r in x.items():
            follow.setdefault(g[:-1], {})[g[-1]] = r
    known = {}

    def dist(h):
        """P(. | h), by recursion."""
        if h not in known:
            if not h:
                known[h] = lambda w: p1.get(w, unk)
            elif h not in follow:
                known[h] = dist(h[1:])
            else:
                seen, d, lower = follow[h], ds[len(h)], dist(h[1:])
                kept, c = math.fsum(cut(d, r) for r in seen.values()), sum(seen.values())
                den = c + (kept >= c * (1 - 1e-12))
                alpha = (1 - kept / den) / (1 - math.fsum(lower(w) for w in seen))
                known[h] = lambda w: cut(d, seen[w]) / den if w in seen else alpha * lower(w)
        return known[h]

    for h in [h for h in follow if len(h) == 1][:20] + [h for h in follow if len(h) == order - 1][-20:] + [("never", "seen")]:
        p = dist(h)
        assert math.fsum([*(p(w) for w in one), p("<unk>")]) == pytest.approx(1, abs=1e-9)
    out = []
    for (i, _), d, o in zip(rows, docs, held):
        base = math.fsum(math.log10((one[w] + 1) / (n + 1 * (v + 1))) for w in d)
        padded = ["<begin>", *d]
        score = math.fsum(math.log10(dist(tuple(padded[max(0, k + 2 - order) : k + 1]))(w)) for k, w in enumerate(d))
        out.append((i, o, len(d), sum(one[w] > 0 for w in d), n, base, score))
    return out


def check(spark, rows, order=katz.ORDER):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    key = lambda r: str(r[:5]) + f"{r[5]:.6f}"
    got = sorted((tuple(r) for r in katz.lm_scores(df, order=order).collect()), key=key)
    want = sorted(brute(rows, order), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def rows_of(n=120):
    rng = random.Random(5)
    vocab = [f"W{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["ÉÀ", "the", "The", "THE"]
    rows = [(k, rng.choice([" ", "\n\t"]).join(rng.choice(vocab) for _ in range(rng.randrange(0, 60)))) for k in range(n)]
    return rows + [(None, "the the the"), (1, None), (3, ""), (3, "x the"), (3, "x the"), (777, "the " * 5000)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_matches_brute_force(spark, order):
    check(spark, rows_of(), order)


def test_unknown_words_after_known_contexts(spark, monkeypatch):
    monkeypatch.setattr(store, "GROUP_BYTES", 40)
    held = [k for k in range(300) if katz.held_out(k)][:6]
    train = [(k, "a b c d a b e") for k in range(300, 340) if not katz.held_out(k)]
    check(spark, train + [(held[0], "a x"), (held[1], "a b x c"), (held[2], "x a b"), (held[3], "e a c"), (held[4], "b"), (held[5], "a b c x")])


def test_frequent_contexts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(katz, "HOT_COUNT", 20)
    monkeypatch.setattr(store, "GROUP_BYTES", 3000)
    check(spark, rows_of())


def test_no_training_rows(spark):
    held = next(k for k in range(1000) if katz.held_out(k))
    r, = katz.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert katz.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_integers_survive_packing():
    for x in ([], [0], [5, 5, 900, 1 << 62], list(range(300))):
        x = np.array(x, np.uint64)
        assert katz.unplanes(katz.planes(x)).tolist() == x.tolist() == katz.unrising(katz.rising(x)).tolist()


@pytest.mark.parametrize("n_buckets", [7, 70_000])
def test_n_grams_are_dealt_in_order_without_a_sort_by_three_keys(monkeypatch, n_buckets):
    ids, texts = zip(*[(i, (t or "").encode()) for i, t in rows_of()])
    group = katz.Group(store.squeeze(katz.tokens_of(list(ids), list(texts))), n_buckets, len(ids), 20)
    group.count = np.where(np.arange(len(group.words)) % 5, group.trained, 0)  # as if every fifth word were in no training text
    group.number = np.where(group.count > 0, (group.bucket << 32) + np.cumsum(group.count > 0), 0)
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: pytest.fail("three passes over all n-grams"))
    level = group.add_level()
    assert level.hot.any() and len(level.missed) and len(set(level.bucket.tolist())) > 5
    assert lexsort((level.w, level.h, level.bucket)).tolist() == list(range(len(level.h)))
    assert lexsort((level.numbers[level.missed], level.missed_bucket)).tolist() == list(range(len(level.missed)))
    of_token = np.where(level.gram >= 0, level.w[level.gram], group.token)
    assert (of_token == group.token).all() and (level.h[level.gram] == level.context)[level.gram >= 0].all()
