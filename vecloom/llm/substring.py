"""Exact substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. The smallest hash of its
MINIMISER-word runs is its minimiser; consecutive windows sharing it travel as
one packed string to the bucket of that minimiser, so equal windows always
meet. A bucket sorts its windows, compares equal hashes byte by byte, and tells
each group of documents the smallest doc_id of every window that repeats.

Scale: documents are packed once into groups; a group sends each distinct
packed string once with its smallest and largest doc_id, so a text held by a
third of all rows costs a bucket one entry a group, not one a row. Answers go
back by group. Buckets are weighed first: one that would take over HOT_BYTES,
as a minimiser that most groups hold makes it, is never gathered. Its windows
travel singly, once a group, to a grouping by the window itself, which Spark
combines before the shuffle, and back by a join, which Spark splits where
skewed. The driver learns one byte total and the numbers of such buckets, at
most one for each HOT_BYTES sent.

Defined results: a null text has no words; a text with fewer words than a
window loses nothing; a null doc_id counts as larger than all others (and null
ids never remove each other); rows with equal doc_id never remove each other,
so repeated rows get equal results; every input row gives one output row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import kernel
from vecloom.llm.store import buckets_for, pack_groups, squeeze, text_bytes, unsqueeze

WINDOW = 13
MINIMISER = 3
#: Bytes of packed strings that a bucket takes at most.
HOT_BYTES = 64 << 20
_NONE = np.iinfo(np.int64).max


def _each(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each of length."""
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


def _frame(texts: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """Packed strings with their ids, in few bytes however few they are."""
    ids = np.concatenate([low, high]).astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(low).to_bytes(4, "little") + ids + b"\n".join(texts))


def _framed(frame: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    n = int.from_bytes(raw[:4], "little")
    ids = np.frombuffer(raw, np.int64, 2 * n, 4)
    return raw[4 + 16 * n :], ids[:n], ids[n:]


class Group:
    """The words, packed strings and buckets of one group of documents, always in the same order."""

    def __init__(self, blob: bytes, n_buckets: int, hot: np.ndarray | None = None):
        """hot: the buckets, in order, whose windows travel singly."""
        self.ids, texts = unsqueeze(blob)
        self.key = np.array([_NONE if i is None else i for i in self.ids], np.int64)
        raw, begins = kernel.join_texts(texts)
        starts, ends = kernel.word_bounds(raw)
        self.doc = np.searchsorted(begins, starts, side="right") - 1
        keep = ~kernel.is_space(raw)
        keep[ends] = True
        #: Words in one buffer, one space after each.
        self.flat = np.where(keep & kernel.is_space(raw), np.uint8(32), raw)[keep]
        self.at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=self.at[1:])
        self.words = kernel.word_hashes(raw, starts, ends)
        n = len(self.words) - WINDOW + 1
        if n <= 0:
            self.run = self.length = self.to = self.single = np.empty(0, np.int64)
            return
        low = kernel.ngram_hashes(self.words, MINIMISER)
        span, width = WINDOW - MINIMISER + 1, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        inside = self.doc[:n] == self.doc[WINDOW - 1 :]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (self.doc[1:n] != self.doc[: n - 1])
        self.run = np.flatnonzero(first)
        breaks = np.flatnonzero(first | ~inside)
        after = np.append(breaks, n)[np.searchsorted(breaks, self.run, side="right")]
        self.length = after - self.run
        #: Bucket of each run.
        self.to = (kernel.mix(low[self.run] + np.uint64(1)) % np.uint64(n_buckets)).astype(np.int64)
        self.single = np.empty(0, np.int64)
        if hot is not None and len(hot):
            apart = np.isin(self.to, hot)
            self.single = _each(self.run[apart], self.length[apart])
            self.run, self.length, self.to = (x[~apart] for x in (self.run, self.length, self.to))

    def sizes(self):
        """(bucket, bytes sent to it), strings told apart by hashes."""
        if not len(self.run):
            return self.run, self.run
        name = kernel.mix(kernel.ngram_hashes(self.words, WINDOW)[self.run] + self.length.astype(np.uint64))
        _, at = np.unique(name, return_index=True)
        size = self.at[self.run[at] + self.length[at] + WINDOW - 1] - self.at[self.run[at]] + 16
        bucket, of = np.unique(self.to[at], return_inverse=True)
        return bucket, np.bincount(of, weights=size).astype(np.int64)

    def _strings(self, begin: np.ndarray, length: np.ndarray):
        """The distinct strings of runs of windows: (which of them each is, strings, a run of each, smallest and largest id)."""
        flat = self.flat.tobytes()
        packed = [flat[a:b] for a, b in zip(self.at[begin].tolist(), (self.at[begin + length + WINDOW - 1] - 1).tolist())]
        code, texts = pd.factorize(np.array(packed, dtype=object))
        where = np.empty(len(texts), np.int64)
        where[code[::-1]] = np.arange(len(begin))[::-1]
        low, high = np.full(len(texts), _NONE), np.full(len(texts), np.iinfo(np.int64).min)
        owner = self.key[self.doc[begin]]
        np.minimum.at(low, code, owner)
        np.maximum.at(high, code, owner)
        return code, texts, where, low, high

    def pack(self) -> "Group":
        """Packs the runs, in the order of their buckets."""
        code, texts, where, low, high = self._strings(self.run, self.length)
        bucket = self.to[where]
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.code, self.bucket, self.texts, self.low, self.high = place[code], bucket[order], texts[order], low[order], high[order]
        return self

    def singles(self):
        """(strings, smallest and largest id) of windows that travel singly."""
        _, texts, _, low, high = self._strings(self.single, np.ones(len(self.single), np.int64))
        return texts, low, high

    def blocks(self):
        """(bucket, its packed strings and their smallest and largest ids), each bucket once."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(self.bucket))):
            yield int(self.bucket[a]), _frame(self.texts[a:b], self.low[a:b], self.high[a:b])

    def covered(self, answers: dict[int, tuple], singles: tuple | None = None) -> np.ndarray:
        """Which words lie in a window that starts in a smaller document; singles: (places, smallest ids) of single windows."""
        mark = np.zeros(len(self.at), np.int64)
        if singles:
            code, texts, *_ = self._strings(self.single, np.ones(len(self.single), np.int64))
            least = np.full(len(texts), _NONE)
            least[singles[0]] = singles[1]
            gone = self.single[least[code] < self.key[self.doc[self.single]]]
            np.add.at(mark, gone, 1)
            np.add.at(mark, gone + WINDOW, -1)
        if answers and len(self.run):
            edges = np.searchsorted(self.bucket, list(answers))
            index = np.concatenate([e + a[0] for e, a in zip(edges, answers.values())])
            sizes = np.concatenate([a[1] for a in answers.values()])
            least = np.concatenate([a[2] for a in answers.values()])
            offset = np.cumsum(sizes) - sizes
            answer = np.full(len(self.bucket), -1, np.int64)
            answer[index] = np.arange(len(index))
            hit = np.flatnonzero(answer[self.code] >= 0)
            which, n = answer[self.code[hit]], self.length[hit]
            step = _each(np.zeros(len(n), np.int64), n)
            window = np.repeat(self.run[hit], n) + step
            gone = window[least[np.repeat(offset[which], n) + step] < self.key[self.doc[window]]]
            np.add.at(mark, gone, 1)
            np.add.at(mark, gone + WINDOW, -1)
        return np.cumsum(mark)[:-1] > 0

    def results(self, gone: np.ndarray):
        """Per document: id, words, removed words, kept words joined by a space."""
        n_docs = len(self.ids)
        n_words = np.bincount(self.doc, minlength=n_docs)
        n_gone = np.bincount(self.doc[gone], minlength=n_docs)
        kept = self.flat[np.repeat(~gone, np.diff(self.at))].tobytes()
        sizes = np.bincount(self.doc, weights=np.diff(self.at) * ~gone, minlength=n_docs).astype(np.int64)
        to = np.cumsum(sizes)
        texts = [kept[e - s : e - 1] if s else b"" for e, s in zip(to.tolist(), sizes.tolist())]
        return pa.array(self.ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())


def _judge(table: pa.Table) -> pa.Table:
    """One bucket: for each group, its packed strings with a window that also starts in a smaller document."""
    bucket, gids, blobs = table.column("bucket")[0], table.column("gid").to_pylist(), table.column("blob")
    parts = [_framed(b.as_py()) for b in blobs]
    raw, _ = kernel.join_texts([p[0] for p in parts])
    low, high = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    sizes = [len(p[1]) for p in parts]
    del parts
    starts, ends = kernel.word_bounds(raw)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)  # packed string of each word
    words = kernel.word_hashes(raw, starts, ends)
    n = len(words) - WINDOW + 1
    window = np.flatnonzero(line[:n] == line[WINDOW - 1 :])
    hashes = kernel.ngram_hashes(words, WINDOW)[window]
    order = np.argsort(hashes, kind="stable")
    window, hashes = window[order], hashes[order]
    new = np.ones(len(window), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    runs = np.flatnonzero(new)
    count = np.diff(np.append(runs, len(window)))
    cls = np.cumsum(new) - 1
    # Equal hashes are compared byte by byte; any that differ get classes of their own.
    again = np.flatnonzero(~new)
    head = runs[cls[again]]
    data = raw.tobytes()
    a0, a1 = starts[window[again]].tolist(), ends[window[again] + WINDOW - 1].tolist()
    b0, b1 = starts[window[head]].tolist(), ends[window[head] + WINDOW - 1].tolist()
    unequal = [k for k, (p, q, r, s) in enumerate(zip(a0, a1, b0, b1)) if data[p:q] != data[r:s]]
    extra: dict[bytes, int] = {}
    for k in unequal:
        cls[again[k]] = extra.setdefault(data[a0[k] : a1[k]], len(runs) + len(extra))
    least = np.full(len(runs) + len(extra), _NONE)
    if unequal:
        np.minimum.at(least, cls, low[line[window]])
    else:
        least = np.minimum.reduceat(low[line[window]], runs) if len(runs) else least
    found = np.empty(n if n > 0 else 0, np.int64)
    found[window] = least[cls]
    window = np.sort(window)
    of, value = line[window], found[window]
    told = np.bincount(of, weights=value < high[of], minlength=len(low)) > 0
    length = np.bincount(of, minlength=len(low))
    out_gid, out_blob, base = [], [], 0
    edge = np.append(np.cumsum(length) - length, len(of))
    for gid, size in zip(gids, sizes):
        mine = np.flatnonzero(told[base : base + size])
        if len(mine):
            part = slice(edge[base], edge[base + size])
            out_gid.append(gid)
            out_blob.append(squeeze((mine, length[base + mine], value[part][told[of[part]]])))
        base += size
    return pa.table({"gid": pa.array(out_gid, pa.int64()), "bucket": pa.array([bucket.as_py()] * len(out_gid), pa.int32()), "blob": pa.array(out_blob, pa.binary())})


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text."""
    n_buckets = buckets_for(df.sparkSession, text_bytes(df, text_col))
    groups = pack_groups(df, id_col, text_col, "substring").select("gid", "blob")

    def weigh(batches):
        for batch in batches:
            for blob in batch.column(1):
                bucket, size = Group(blob.as_py(), n_buckets).sizes()
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(size, pa.int64())], names=["bucket", "size"])

    weights = groups.mapInArrow(weigh, "bucket int, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
    hot = np.sort(weights.where(F.col("size") > hot_bytes).select("bucket").toArrow().column(0).to_numpy())

    def send(batches):
        for batch in batches:
            for gid, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(Group(blob.as_py(), n_buckets, hot).pack().blocks())
                if rows:
                    bucket, blocks = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([gid] * len(rows), pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "gid", "blob"])

    def send_singles(batches):
        for batch in batches:
            for gid, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts, low, high = Group(blob.as_py(), n_buckets, hot).singles()
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([gid] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(list(texts), pa.binary()), pa.array(low), pa.array(high)], names=["gid", "place", "window", "low", "high"])

    def bound(batches):
        """Places and smallest ids of a group's single windows as an answer of bucket -1."""
        for batch in batches:
            pairs = [(np.array([p["place"] for p in x]), np.array([p["least"] for p in x])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1] * len(pairs), pa.int32()), pa.array([squeeze(p) for p in pairs], pa.binary())], names=["gid", "bucket", "blob"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=names)
        group = Group(left.column("blob")[0].as_py(), n_buckets, hot).pack()
        answers = {b: unsqueeze(x.as_py()) for b, x in zip(right.column("bucket").to_pylist(), right.column("blob"))}
        singles = answers.pop(-1, None)
        return pa.table(group.results(group.covered(answers, singles)), names=names)

    answers = groups.mapInArrow(send, "bucket int, gid long, blob binary").groupBy("bucket").applyInArrow(_judge, "gid long, bucket int, blob binary")
    if len(hot):
        rows = groups.mapInArrow(send_singles, "gid long, place int, window binary, low long, high long")
        least = rows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("window", "least")
        told = rows.join(least, "window").where("least < high").groupBy("gid").agg(F.collect_list(F.struct("place", "least")).alias("told"))
        answers = answers.unionByName(told.mapInArrow(bound, "gid long, bucket int, blob binary"))
    return groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")
