"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage of the
whole text is encoded as hashed word-shape and character-pair shares plus a few
ratios, then by a small tanh layer; gated attention (tanh times sigmoid) weighs
the passages, and a logistic unit scores the weighted sum. Weights are learned
by Adam from document labels alone.

Fit sample (documented bound): the FIT_DOCS labelled doc_ids, held-out ones left
out, with the smallest hash, and of each the text with the smallest hash. Every
passage of those texts is learned from, in the driver; scoring is one pass over
the scan with the weights sent along (a few hundred KB), and covers every
passage.

Defined results: null and empty texts are bags of one passage with no words and
score by the model as such; rows are scored one by one, so repeated rows and
null ids are fine; without any usable label every score is 0.5. An empty table
gives no rows; very long texts are scored whole; other columns, whatever their
names, are not looked at and come back unchanged from reject_low_quality().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import kernel
from vecloom.llm.store import small_batches, tidied, tidy

PASSAGE_WORDS = 64
FIT_DOCS = 3000
HASHED = 192
RATIOS = 10
WIDTH = HASHED + RATIOS
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 3e-3, 1e-4
SEED = 7


def encode(text: bytes) -> np.ndarray:
    """Features of all passages of a text: (passages, WIDTH) floats; one row of zeros where there are no words."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = kernel.word_bounds(raw)
    n = len(starts)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    m = -(-n // PASSAGE_WORDS)
    passage = np.minimum(np.arange(n) // PASSAGE_WORDS, m - 1)
    word = np.repeat(np.arange(n), ends - starts)
    inside = ~kernel.is_space(raw)
    ch = raw[inside]
    of = passage[word]
    size = np.bincount(of, minlength=m).astype(np.float64)
    words = np.bincount(passage, minlength=m).astype(np.float64)

    def share(mask, by=of, total=size):
        return np.bincount(by, weights=mask.astype(np.float64), minlength=m) / total

    upper = (ch >= 65) & (ch <= 90)
    lower = (ch >= 97) & (ch <= 122)
    digit = (ch >= 48) & (ch <= 57)
    high = ch >= 128
    other = ~(upper | lower | digit | high)
    hashes = kernel.word_hashes(raw, starts, ends)
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((hashes, passage))
    fresh = np.ones(n, bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    length = ends - starts
    bare = np.ones(n, bool)
    bare[word[~other]] = False  # words of symbols only
    last = raw[ends - 1]
    marked = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57) | (last >= 128))
    ratios = [
        share(upper), share(digit), share(other), share(high),
        share(same, passage, words), 1 - np.bincount(passage[order], weights=fresh, minlength=m) / words,
        np.minimum(np.bincount(passage, weights=length, minlength=m) / words / 12, 3), share(bare, passage, words),
        share(marked, passage, words), words / PASSAGE_WORDS,
    ]
    # Pairs of characters within a word, hashed; letters keep their case, others their byte.
    pair = word[1:] == word[:-1]
    code = ((ch[:-1].astype(np.uint32) * 257 + ch[1:]) * np.uint32(2654435761) >> np.uint32(16)) % HASHED
    flat = of[1:][pair].astype(np.int64) * HASHED + code[pair]
    counts = np.bincount(flat, minlength=m * HASHED).reshape(m, HASHED)
    hashed = np.sqrt(counts / np.maximum(size, 1)[:, None])
    return np.hstack([hashed, np.array(ratios).T * 2]).astype(np.float32)


class Model:
    """Encoder, gated attention and scorer."""

    def __init__(self, rng: np.random.Generator):
        def layer(a, b):
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        self.w = {"enc": layer(WIDTH, HIDDEN), "enc_b": np.zeros(HIDDEN), "tan": layer(HIDDEN, GATE), "sig": layer(HIDDEN, GATE), "att": layer(GATE, 1)[:, 0], "out": layer(HIDDEN, 1)[:, 0], "out_b": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bag: np.ndarray, n_bags: int) -> dict:
        """bag: non-decreasing bag number of each row of x, every bag with a row."""
        w = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, s = np.tanh(h @ w["tan"]), 1 / (1 + np.exp(-(h @ w["sig"])))
        e = (t * s) @ w["att"]
        first = np.searchsorted(bag, np.arange(n_bags))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "first": first, "p": 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))}

    def gradients(self, f: dict, bag: np.ndarray, y: np.ndarray) -> dict:
        w, g = self.w, {}
        d = (f["p"] - y) / len(y)
        g["out"], g["out_b"] = f["z"].T @ d, d.sum(keepdims=True)
        dz = d[:, None] * w["out"]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[bag])
        g["att"] = (f["t"] * f["s"]).T @ de
        du = de[:, None] * w["att"]
        dt, ds = du * f["s"] * (1 - f["t"] ** 2), du * f["t"] * f["s"] * (1 - f["s"])
        g["tan"], g["sig"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["a"][:, None] * dz[bag] + dt @ w["tan"].T + ds @ w["sig"].T
        dh *= 1 - f["h"] ** 2
        g["enc"], g["enc_b"] = f["x"].T @ dh, dh.sum(0)
        return g

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> "Model":
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.05
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                bag = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
                g = self.gradients(self.forward(np.concatenate([bags[i] for i in own]), bag, len(own)), bag, y[own])
                step += 1
                for k, v in g.items():
                    v = v + DECAY * self.w[k] * (k != "out_b")
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.w[k] = self.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, held, size, at = np.empty(len(texts)), [], 0, 0
        for k, t in enumerate(texts):
            held.append(encode(t))
            size += len(held[-1])
            if size > 8000 or k == len(texts) - 1:
                bag = np.repeat(np.arange(len(held)), [len(b) for b in held])
                out[at : k + 1] = self.forward(np.concatenate(held), bag, len(held))["p"]
                held, size, at = [], 0, k + 1
        return out


def held_out(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learns from the bounded sample of labelled rows that are not held out; None if one class is missing.

    A doc_id with several label rows takes the smallest label.
    """

    def run(batches):
        for batch in batches:
            rows = [encode((text.as_py() or "").encode()).ravel() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    )
    chosen = F.broadcast(chosen)  # FIT_DOCS rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id")
    # One text of each doc_id, so none is crowded out by repeats of another.
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.select("doc_id", "text", "label").mapInArrow(tidied(run), "doc_id long, label int, x array<float>").toArrow().sort_by("doc_id")
    y = np.array(found.column("label").to_pylist(), float)
    if len(set(y)) < 2:
        return None
    bags = [np.asarray(x.values, np.float32).reshape(-1, WIDTH) for x in found.column("x")]
    del found
    rng = np.random.default_rng(SEED)
    model = Model(rng).fit(bags, y, rng)
    del bags
    tidy()  # the driver's Python lives on
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            scores = model.score(texts) if model is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, all columns unchanged. Scores in place: no join, no shuffle."""
    model = fit(docs, labels, id_col, text_col)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(at)]
            keep = model.score(texts) >= 0.5 if model is not None else np.ones(len(texts), bool)
            yield batch.filter(pa.array(keep))

    return docs.select(*names).mapInArrow(tidied(run), docs.schema)
