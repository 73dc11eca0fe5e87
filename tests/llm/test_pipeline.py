"""run() against a plain Python version of every stage but the classifier, whose decisions are taken from its own model."""

import hashlib
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vecloom.llm import bpe, quality
from vecloom.session import sample_dir, table


def classes(items, alike):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in alike:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in items}


def close(a, b):
    """Within an edit for every 12 characters of the shorter, two at most (one row at a time, in a band)."""
    most = min(2, min(len(a), len(b)) // 12)
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(3)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - 2), min(len(b), i + 2) + 1):
            new[j] = min(row.get(j, 9) + 1, new.get(j - 1, 9) + 1, row.get(j - 1, 9) + (j > 0 and a[i - 1] != b[j - 1]) if j else 9)
        row = new
        if min(row.values()) > 2:
            return False
    return row.get(len(b), 9) <= most


def line_dedup(docs):
    lines = sorted({x for _, t in docs for x in t.split("\n") if x.strip(" ")})
    near = {}
    for x in lines:  # two edits leave one third of a line unchanged, one edit half of it, near its place
        if len(x) >= 12:
            for d in range(-2, 3):
                n = (len(x) + d) // (3 if len(x) >= 24 else 2)
                for s in range(0, len(x) + d - n + 1, n):
                    for o in range(-2, 3):
                        if s + o >= 0:
                            near.setdefault((n, s, x[s + o : s + o + n]), set()).add(x)
    alike = {(a, b) for group in near.values() for a in group for b in group if a < b and len(group) < 400}
    root = classes(lines, [(a, b) for a, b in alike if close(a, b)])
    first = {}
    for i, t in sorted(docs):
        for n, x in enumerate(t.split("\n")):
            if x.strip(" "):
                first.setdefault(root[x], (i, n))
    return [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" ") or first[root[x]] == (i, n))) for i, t in docs]


def near_dedup(docs):
    def bag(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])

    bags, by = {i: bag(t) for i, t in docs}, {}
    for i, b in bags.items():
        for s in b:
            by.setdefault(s, set()).add(i)
    pairs = {(x, y) for g in by.values() for x in g for y in g if x < y}

    def alike(x, y):
        low = sum((bags[x] & bags[y]).values())
        return low >= 0.8 * (sum(bags[x].values()) + sum(bags[y].values()) - low)

    root = classes(bags, [p for p in pairs if alike(*p)])
    return [(i, t) for i, t in docs if root[i] == i]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run(spark, sf):
    d = sample_dir(sf)
    docs = table(spark, d, "documents")
    scores = quality.quality_scores(docs, table(spark, d, "labels")).where("predicted = 1")
    kept = {r.doc_id for r in scores.collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    rows = near_dedup(line_dedup(rows))
    clean = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [clean(r.text) for r in table(spark, d, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not any(f" {x} " in f" {clean(t)} " for x in items)]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "some text here", "en", "s", 3), (2, "", "en", "s", 0), (3, "a line of text that is long enough\n" * 3, "en", "s", 99), (3, "a line of text that is long enough\n" * 3, "en", "s", 99)], "doc_id long, text string, lang string, source string, n_chars long")
    d = sample_dir("sf0.001")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.collect()
        assert stage(spark, docs.limit(0), d).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == 5
