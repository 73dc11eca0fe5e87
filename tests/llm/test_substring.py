import random
import re

import pytest

from vecloom.llm import kernel, substring
from vecloom.llm.store import buckets_for


def brute(rows, w=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in docs:
        for k in range(len(words) - w + 1):
            key = tuple(words[k : k + w])
            i2 = float("inf") if i is None else i
            first[key] = min(first.get(key, i2), i2)
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for k in range(len(words) - w + 1):
            if first[tuple(words[k : k + w])] < (float("inf") if i is None else i):
                gone[k : k + w] = [True] * w
        out.append((i, len(words), sum(gone), " ".join(x for x, g in zip(words, gone) if not g)))
    return sorted(out, key=str)


def rows_of(seed=1):
    rng = random.Random(seed)
    vocab = ["ä", "the", "of", "wörd", "x", "aa", "日本", "q" * 40]
    passage = " ".join(rng.choice(vocab) + str(rng.randrange(9)) for _ in range(40))
    rows = [(9, passage), (3, passage), (3, passage), (None, passage), (None, passage + " tail end"), (5, None), (6, ""), (7, " \t\n"), (8, "the " * 300), (2, "the " * 20), (11, "one two three")]
    for k in range(20, 80):
        words = [rng.choice(vocab) + str(rng.randrange(4)) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.6:
            at = rng.randrange(0, 25)
            words[len(words) // 2 : len(words) // 2] = passage.split()[at : at + rng.randrange(5, 30)]
        rows.append((k, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    rows.append((100, "big " + " ".join(str(rng.random()) for _ in range(60000))))
    return rows


def check(spark, rows, hot_bytes=substring.HOT_BYTES):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(df, hot_bytes=hot_bytes).collect()), key=str)
    assert got == brute(rows)


def test_matches_brute_force(spark):
    check(spark, rows_of())


def packed(rows):
    return substring.squeeze(([i for i, _ in rows], [(t or "").encode() for _, t in rows]))


@pytest.mark.parametrize("share", [0, 0.5])
def test_windows_of_heavy_buckets_travel_singly(spark, share):
    rows = rows_of(3)
    n_buckets = buckets_for(spark, sum(len((t or "").encode()) for _, t in rows))
    _, sizes = substring.Group(packed(rows), n_buckets).sizes()
    assert len(sizes) > 3
    check(spark, rows, int(sorted(sizes)[int(share * len(sizes))]) if share else 0)


def test_survives_hash_collisions(monkeypatch):
    rows = rows_of(2)[:50]
    group = substring.Group(packed(rows), 1).pack()
    import pyarrow as pa

    (bucket, blob), = group.blocks()
    real = kernel.ngram_hashes
    monkeypatch.setattr(kernel, "ngram_hashes", lambda w, n: real(w, n) % 7 if n == 13 else real(w, n))
    out = substring._judge(pa.table({"bucket": pa.array([0], pa.int32()), "gid": [0], "blob": pa.array([blob], pa.binary())}))
    answers = {0: substring.unsqueeze(out.column("blob")[0].as_py())}
    got = sorted(zip(*(c.to_pylist() for c in group.results(group.covered(answers)))), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
