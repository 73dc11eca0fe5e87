"""Katz backoff model of ORDER words over lower-cased words, learned from and applied to whole documents.

Tokens of a document are its words and one end; the context of a token are the
ORDER - 1 before it, or as many as there are, the first token having a begin
mark. For a context h seen in training, h' being h without its first word,

    P(w | h) = d_r * r / c(h)            where r = c(h, w) > 0
             = alpha(h) * P(w | h')      otherwise
    alpha(h) = (1 - sum of the upper line) / (1 - sum of P(w | h') over seen w)

and P(w | h') for an unseen context; P(w) is Good-Turing discounted over N + 1
tokens, what is left going to one slot for unknown words. d_r are Katz's
Good-Turing discounts of each order for r <= K, else 1. A context whose counts
leave nothing is read over c(h) + 1. So every distribution sums to one over
V + 1 words.

Scale: documents are packed once into groups. Order by order, a group sends each
distinct n-gram once to the bucket that counts it, as sorted integers (a context
is told by the number it got an order below); buckets write their counts as
tables of slices, one for each group that asked, which come back to score the
group. What a context's backoff weight needs is sent back only where a word
unseen after it was asked for. Contexts frequent enough to fill a bucket are
dealt out by the n-gram instead, and their sums gathered (no more than
HOT_CONTEXTS of them exist by definition). All counts cover all training
documents; the driver sees the counts of counts and hot sums only.

Defined results: a null text is empty (one end token); a null id is never held
out; rows are scored one by one, each training row counts, repeated or not; an
empty training set gives all mass to the unknown slot (score and base_score 0).
An empty table gives no rows; a text longer than a group is a group of its own;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import kernel
from vecloom.llm.store import buckets_for, pack_groups, squeeze, text_bytes, unsqueeze, written

ORDER = 3
K = 5
HOT_CONTEXTS = 100_000
HOT_COUNT = 65_536
_END, _BEGIN = np.uint64(0x51ED270B0A1B2C3D), np.int64(1) << np.int64(62)
_SLICE = "kind int, gid long, bucket int, blob binary"
ANSWER, STATS, HOT = 0, 1, 2


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def planes(x: np.ndarray) -> tuple:
    """Non-negative integers as byte planes, which compress well."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return len(x), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(packed: tuple) -> np.ndarray:
    n, data = packed
    out = np.zeros((n, 8), np.uint8)
    if n:
        part = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(part)] = part.T
    return out.view(np.uint64)[:, 0]


def rising(x: np.ndarray) -> tuple:
    return planes(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unrising(packed: tuple) -> np.ndarray:
    return np.cumsum(unplanes(packed), dtype=np.uint64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d_1..d_K from the numbers n_1..n_{K+1} of types seen so often; absolute ones where those are no discounts."""
    n = np.asarray(n, float)
    r = np.arange(1, K + 1)
    with np.errstate(all="ignore"):
        tail = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:K]) - tail) / (1 - tail)
    if np.all(np.isfinite(d)) and np.all((d > 0) & (d < 1)):
        return d
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return (r - off) / r


def tokens_of(ids: list, texts: list[bytes]) -> tuple:
    """A group's ids, its documents' numbers of tokens, its distinct words (hashes, most frequent first) and its tokens as their places."""
    raw, begins = kernel.join_texts(texts)
    raw = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
    starts, ends = kernel.word_bounds(raw)
    doc = np.searchsorted(begins, starts, side="right") - 1
    tokens = np.full(len(starts) + len(ids), _END)
    tokens[np.arange(len(starts)) + doc] = kernel.word_hashes(raw, starts, ends)
    code, words = pd.factorize(tokens)
    order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return ids, planes(np.bincount(doc, minlength=len(ids)) + 1), planes(words[order]), planes(place[code])


def _sorted_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value among the distinct ones, and those, sorted."""
    code, kinds = pd.factorize(x)
    order = np.argsort(kinds)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[code], kinds[order]


def by_bucket(bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """The order by bucket, of equal ones as they are: numbers of 16 bits are sorted by counting."""
    return np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")


class Level:
    """The n-grams of one order in a group, in the order in which they are sent.

    context: of each token, its context's place in the order below, or -1 if it has none or one not in training;
    gram: its n-gram's place here, or -1 if what follows the context's first word is not in training, so it can't be.
    """

    def __init__(self, group: "Group", context: np.ndarray, numbers: np.ndarray, counts: np.ndarray, below: np.ndarray):
        """numbers and counts of contexts; below: of each token, the count of its n-gram of the order below."""
        n = len(group.words)
        self.context = np.where((context >= 0) & (counts[context] > 0), context, -1)
        self.numbers, self.counts, self.hot = numbers, counts, counts > group.hot
        asked = (self.context >= 0) & (below > 0)
        code, kinds = pd.factorize(self.context[asked] * np.int64(n) + group.token[asked])
        h, w = kinds // n, kinds % n
        bucket = numbers[h] >> 32
        dealt = self.hot[h]
        bucket[dealt] = (kernel.mix((numbers[h[dealt]] + group.number[w[dealt]] * 31).astype(np.uint64)) >> np.uint64(2)).astype(np.int64)
        bucket %= group.n_buckets
        order = np.argsort(kinds)  # as by h, then w
        order = order[by_bucket(bucket[order], group.n_buckets)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.gram = np.full(len(context), -1)
        self.gram[asked] = place[code]
        self.h, self.w, self.bucket = h[order], w[order], bucket[order]
        trained = asked & ~group.held[group.doc]
        self.trained = np.bincount(self.gram[trained], minlength=len(order))
        self.below = np.zeros(len(order), np.int64)
        self.below[self.gram[asked]] = below[asked]
        self.words = group.number[self.w]
        # Contexts of tokens that can't have been seen after them: their weights are needed whatever the counts are.
        missed = np.unique(self.context[(self.context >= 0) & ~asked])
        missed = missed[~self.hot[missed]]
        self.missed = missed[np.argsort(numbers[missed], kind="stable")]
        self.missed_bucket = (numbers[self.missed] >> 32) % group.n_buckets
        order = by_bucket(self.missed_bucket, group.n_buckets)
        self.missed, self.missed_bucket = self.missed[order], self.missed_bucket[order]

    def parts(self):
        """(bucket, its n-grams, the first of each context among them, its contexts missed)."""
        for b in np.union1d(self.bucket, self.missed_bucket).tolist():
            lo, hi = np.searchsorted(self.bucket, [b, b + 1]).tolist()
            mlo, mhi = np.searchsorted(self.missed_bucket, [b, b + 1]).tolist()
            yield b, slice(lo, hi), np.flatnonzero(np.diff(self.h[lo:hi], prepend=-1)), slice(mlo, mhi)

    def blocks(self):
        """Contexts and words of a block rise, as numbers do from place to place."""
        for b, part, first, missed in self.parts():
            h = self.h[part][first]
            yield b, squeeze((rising(self.numbers[h]), planes(np.diff(np.append(first, part.stop - part.start))), planes(self.words[part]), planes(self.trained[part]), planes(self.below[part]), np.packbits(self.hot[h]), rising(self.numbers[self.missed[missed]])))

    def learn(self, slices: dict[int, bytes]) -> None:
        """Takes every n-gram's count and number, and sums of counts of the contexts that need them."""
        self.count, self.number = np.zeros(len(self.h), np.int64), np.zeros(len(self.h), np.int64)
        self.full = np.zeros(len(self.counts), bool)
        self.sums = np.zeros((len(self.counts), 2 * K + 2), np.int64)
        for b, part, first, missed in self.parts():
            count, rank, full, sums = unsqueeze(slices[b])
            self.count[part] = count = unplanes(count).astype(np.int64)
            number = np.zeros(len(count), np.int64)
            number[count > 0] = (b << 32) + unrising(rank).astype(np.int64)
            self.number[part] = number
            h = self.h[part][first]
            self.full[h] = np.unpackbits(full, count=len(h)).astype(bool)
            own = self._needed(h, np.minimum.reduceat(count, first) if len(first) else count, self.missed[missed])
            self.sums[own] = unplanes(sums).reshape(-1, 2 * K + 2)
            self.full[own] = self.sums[own, :K].sum(1) == 0

    def _needed(self, h: np.ndarray, least: np.ndarray, missed: np.ndarray) -> np.ndarray:
        needed = np.union1d(h[(least == 0) & ~self.hot[h]], missed)
        return needed[np.argsort(self.numbers[needed])]

    def learn_hot(self, numbers: np.ndarray, sums: np.ndarray) -> None:
        mine = np.flatnonzero(self.hot)
        if len(mine) and len(numbers):
            at = np.minimum(np.searchsorted(numbers, self.numbers[mine]), len(numbers) - 1)
            mine, at = mine[numbers[at] == self.numbers[mine]], at[numbers[at] == self.numbers[mine]]
            self.sums[mine] = sums[at]
            self.full[mine] = sums[at, :K].sum(1) == 0

    def probability(self, lower: np.ndarray, over: np.ndarray, own: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Of each token, from the probabilities an order below: over is, by token, what those counts are read over
        there; own and below are the discounts of this order and that."""
        r = np.arange(1, K + 1)
        kept = self.sums[:, :K] @ (own * r) + self.sums[:, K]
        self.whole = self.counts + self.full.astype(float)
        has = self.context >= 0
        base = np.ones(len(self.counts))
        base[self.context[has]] = over[has]
        observed = (self.sums[:, K + 1 : 2 * K + 1] @ (below * r) + self.sums[:, 2 * K + 1]) / base
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = (1 - kept / np.maximum(self.whole, 1)) / (1 - observed)
        times = np.where(self.gram >= 0, np.append(self.count, 0)[self.gram], 0)
        seen = np.append(own, 1.0)[np.clip(times, 1, K + 1) - 1] * times / np.maximum(self.whole[self.context], 1)
        return np.where(times > 0, seen, np.where(has, alpha[self.context] * lower, lower))


class Group:
    """Tokens of one group of documents; its distinct words, sorted by hash, and the bucket of each."""

    def __init__(self, blob: bytes, n_buckets: int, documents: int = 0, hot: int = HOT_COUNT):
        self.ids, sizes, words, tokens = unsqueeze(blob)
        self.n_buckets, self.documents, self.hot = n_buckets, documents, hot
        self.sizes = unplanes(sizes).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.held = np.array([held_out(i) for i in self.ids], bool)
        words = unplanes(words)
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.token, self.words = place[unplanes(tokens).astype(np.int64)], words[order]
        self.trained = np.bincount(self.token[~self.held[self.doc]], minlength=len(order))
        self.bucket = ((self.words >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        self.levels: list[Level] = []

    def word_blocks(self):
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(self.bucket))):
            yield int(self.bucket[a]), squeeze((rising(self.words[a:b]), planes(self.trained[a:b])))

    def learn_words(self, slices: dict[int, bytes]) -> None:
        """Takes each word's count in all of training, and its number (0: unknown)."""
        parts = [unsqueeze(slices[b]) for b in sorted(slices)]
        self.count = np.concatenate([unplanes(p[0]) for p in parts]).astype(np.int64)
        rank = np.concatenate([unplanes(p[1]) for p in parts]).astype(np.int64)
        self.number = np.where(rank > 0, (self.bucket << 32) + rank, 0)

    def add_level(self) -> Level:
        """The n-grams of the next order."""
        if not self.levels:
            last, numbers, counts = self.token, np.append(self.number, _BEGIN if self.documents else 0), np.append(self.count, self.documents)
            begin, below = len(self.words), self.count[self.token]
        else:
            top = self.levels[-1]
            last, numbers, counts = top.gram, np.append(top.number, 0), np.append(top.count, 0)
            begin, below = -1, np.where(top.gram >= 0, counts[top.gram], 0)
        context = np.empty(len(last), np.int64)
        context[1:] = last[:-1]
        context[self.first] = begin
        self.levels.append(Level(self, context, numbers, counts, below))
        return self.levels[-1]

    def scores(self, stats: dict):
        """Per document: id, held_out, n_tokens, n_known, base_score, score."""
        total, vocabulary = stats["N"], stats["V"]
        count = self.count[self.token]
        base = np.log10((count + 1) / (total + 1 * (vocabulary + 1)))
        below = discounts(stats["counts"][0])
        prob = np.where(count > 0, np.append(below, 1.0)[np.clip(count, 1, K + 1) - 1] * count / (total + 1), stats["unknown"])
        over = np.full(len(count), total + 1.0)
        for level, counts in zip(self.levels, stats["counts"][1:]):
            own = discounts(counts)
            prob = level.probability(prob, over, own, below)
            over, below = level.whole[level.context], own

        def by_doc(x):
            return np.add.reduceat(x, self.first)

        return pa.array(self.ids, pa.int64()), pa.array(self.held), pa.array(self.sizes, pa.int64()), pa.array(by_doc((count > 0).astype(np.int64)), pa.int64()), pa.array(by_doc(base)), pa.array(by_doc(np.log10(prob)))


def _slices(rows: list[tuple]) -> pa.Table:
    kind, gid, bucket, blob = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array(kind, pa.int32()), pa.array(gid, pa.int64()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "gid", "bucket", "blob"])


def _of_counts(count: np.ndarray) -> np.ndarray:
    return np.bincount(count[(count > 0) & (count <= K + 1)], minlength=K + 2)[1:]


def _count_words(table: pa.Table) -> pa.Table:
    """One bucket of words: counts over all groups, numbers for those in training, a slice for each group."""
    bucket, gids = table.column("bucket")[0].as_py(), table.column("gid").to_pylist()
    parts = [unsqueeze(b.as_py()) for b in table.column("blob")]
    words = [unrising(p[0]) for p in parts]
    code, kinds = pd.factorize(np.concatenate(words))
    order = np.argsort(kinds)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[code]
    count = np.bincount(code, weights=np.concatenate([unplanes(p[1]) for p in parts]), minlength=len(order)).astype(np.int64)
    rank = np.where(count > 0, np.cumsum(count > 0), 0)
    rows, at = [], 0
    for gid, own in zip(gids, words):
        mine = code[at : at + len(own)]
        rows.append((ANSWER, gid, bucket, squeeze((planes(count[mine]), planes(rank[mine])))))
        at += len(own)
    ends = count[kinds[order] == _END]
    rows.append((STATS, -1, bucket, squeeze((int((count > 0).sum()), int(count.sum()), _of_counts(count), int(ends.sum())))))
    return _slices(rows)


def _count_grams(table: pa.Table) -> pa.Table:
    """One bucket of n-grams: counts over all groups, numbers for those in training and, for contexts with an unseen
    n-gram, what their backoff weights need."""
    bucket, gids = table.column("bucket")[0].as_py(), table.column("gid").to_pylist()
    asks = [unsqueeze(b.as_py()) for b in table.column("blob")]
    contexts = [unrising(p[0]) for p in asks]
    missed = [unrising(p[6]) for p in asks]
    runs = [unplanes(p[1]).astype(np.int64) for p in asks]
    words = [unplanes(p[2]) for p in asks]
    code, distinct = _sorted_codes(np.concatenate([*contexts, *missed]))
    where = np.split(code, np.cumsum([len(x) for x in contexts + missed])[:-1])
    where, missed = where[: len(asks)], where[len(asks) :]
    w_code, w_kinds = _sorted_codes(np.concatenate(words))
    code, kinds = _sorted_codes(np.repeat(np.concatenate(where), np.concatenate(runs)) * np.int64(max(len(w_kinds), 1)) + w_code)
    count = np.bincount(code, weights=np.concatenate([unplanes(p[3]) for p in asks]), minlength=len(kinds)).astype(np.int64)
    rank = np.cumsum(count > 0)
    of = kinds // max(len(w_kinds), 1)
    below = np.zeros(len(kinds), np.int64)
    below[code] = np.concatenate([unplanes(p[4]) for p in asks]).astype(np.int64)
    seen = count > 0
    sums = np.zeros((len(distinct), 2 * K + 2), np.int64)
    for col, x in ((0, count), (K + 1, below)):
        few = seen & (x <= K)
        np.add.at(sums, (of[few], col + x[few] - 1), 1)
        many = seen & (x > K)
        np.add.at(sums[:, col + K], of[many], x[many])
    full = sums[:, :K].sum(1) == 0
    hot = np.zeros(len(distinct), bool)
    rows, at = [], 0
    for gid, own, more, run, p in zip(gids, where, missed, runs, asks):
        mine = code[at : at + int(run.sum())]
        at += len(mine)
        dealt = np.unpackbits(p[5], count=len(own)).astype(bool)
        hot[own[dealt]] = True
        got = count[mine]
        least = np.minimum.reduceat(got, np.cumsum(run) - run) if len(run) else got
        needed = np.union1d(own[(least == 0) & ~dealt], more)
        rows.append((ANSWER, gid, bucket, squeeze((planes(got), rising(rank[mine][got > 0]), np.packbits(full[own]), planes(sums[needed].ravel())))))
    rows.append((STATS, -1, bucket, squeeze((_of_counts(count),))))
    # Of contexts dealt out by the n-gram, this bucket has a part of the sums only.
    if hot.any():
        rows.append((HOT, -1, bucket, squeeze((distinct[hot].astype(np.int64), sums[hot]))))
    return _slices(rows)


def _empty(names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array([], k) for k in kinds], names=names)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = df.sparkSession
    n_buckets = buckets_for(spark, text_bytes(df, text_col))
    groups = pack_groups(df, id_col, text_col, "katz-tokens", tokens_of, by_gid=True).select("gid", "blob")
    asks = "bucket int, gid long, blob binary"

    def send(gid: int, blocks) -> pa.Table:
        bucket, blobs = zip(*blocks)
        return pa.table([pa.array(bucket, pa.int32()), pa.array([gid] * len(bucket), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "gid", "blob"])

    def send_words(batches):
        for batch in batches:
            for gid, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from send(gid, Group(blob.as_py(), n_buckets).word_blocks()).to_batches()

    def answers(asked: DataFrame, count, name: str) -> DataFrame:
        return written(asked.groupBy("bucket").applyInArrow(count, _SLICE), name, ["kind"])

    tables = [answers(groups.mapInArrow(send_words, asks), _count_words, "katz-words")]
    parts = _gather(tables[0])
    stats: dict = {"V": sum(p[0] for p in parts), "N": sum(p[1] for p in parts), "counts": [sum((p[2] for p in parts), np.zeros(K + 1, np.int64))], "hot": []}
    documents = sum(p[3] for p in parts)
    hot = max(HOT_COUNT, stats["N"] // HOT_CONTEXTS)
    first = stats["counts"][0]
    stats["unknown"] = 1 - (stats["N"] - ((1 - discounts(first)) * np.arange(1, K + 1) * first[:K]).sum()) / (stats["N"] + 1)

    def rebuilt(left: pa.Table, right: pa.Table, hot_sums: list) -> Group:
        group = Group(left.column("blob")[0].as_py(), n_buckets, documents, hot)
        by_level: dict[int, dict[int, bytes]] = {}
        for level, bucket, blob in zip(right.column("level").to_pylist(), right.column("bucket").to_pylist(), right.column("blob")):
            by_level.setdefault(level, {})[bucket] = blob.as_py()
        group.learn_words(by_level[0])
        for level, sums in enumerate(hot_sums, 1):
            top = group.add_level()
            top.learn(by_level.get(level, {}))
            top.learn_hot(*sums)
        return group

    def with_slices():
        slices = None
        for level, t in enumerate(tables):
            part = t.where(F.col("kind") == ANSWER).select("gid", F.lit(level).alias("level"), "bucket", "blob")
            slices = part if slices is None else slices.unionByName(part)
        return groups.groupBy("gid").cogroup(slices.groupBy("gid"))

    def sender(hot_sums: list):
        def send_grams(left: pa.Table, right: pa.Table) -> pa.Table:
            blocks = list(rebuilt(left, right, hot_sums).add_level().blocks()) if left.num_rows else []
            return send(left.column("gid")[0].as_py(), blocks) if blocks else _empty(["bucket", "gid", "blob"], [pa.int32(), pa.int64(), pa.binary()])

        return send_grams

    for level in range(1, order):
        tables.append(answers(with_slices().applyInArrow(sender(list(stats["hot"])), asks), _count_grams, f"katz-order-{level + 1}"))
        stats["counts"].append(sum((p[0] for p in _gather(tables[-1])), np.zeros(K + 1, np.int64)))
        stats["hot"].append(_hot_sums(tables[-1]))

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _empty(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])
        return pa.table(rebuilt(left, right, stats["hot"]).scores(stats), names=names)

    scored = with_slices().applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(int(stats["N"])).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _gather(slices: DataFrame) -> list:
    """The counts of counts of a table, one small row a bucket in files of their own, summed by task before they reach the driver."""

    def add(batches):
        total = None
        for batch in batches:
            for blob in batch.column(0):
                part = unsqueeze(blob.as_py())
                total = part if total is None else tuple(x + y for x, y in zip(total, part))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"blob": [squeeze(total)]})

    return [unsqueeze(r.blob) for r in slices.where(F.col("kind") == STATS).select("blob").mapInArrow(add, "blob binary").collect()]


def _hot_sums(slices: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The contexts dealt out, HOT_CONTEXTS at most, and their sums over all buckets."""

    def rows(batches):
        for batch in batches:
            for blob in batch.column(0):
                numbers, sums = unsqueeze(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *[pa.array(c) for c in sums.T.copy()]], names=names)

    names = ["number", *[f"s{k}" for k in range(2 * K + 2)]]
    parts = slices.where(F.col("kind") == HOT).select("blob").mapInArrow(rows, ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("number").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow().sort_by("number")
    return found.column("number").to_numpy().astype(np.int64), np.stack([found.column(n).to_numpy() for n in names[1:]], 1).astype(np.int64)
