"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most PASSAGE words and weighed by
TF-IDF, document frequencies being counted over the whole corpus. A randomised
SVD of the passage matrix (range finder, power steps and projection, all as
partial sums over the passage table) gives a latent space of RANK dimensions;
passages it holds too little of get a further space, so that each passage is
searched in one that holds at least HELD of it. Windows of every document, of
the lengths the passages need, are folded in as sums of word vectors; those
with a cosine of at least COSINE to a passage are candidates (a window shorter
than the passage's vector counts as of its length, as it lacks the rest). A candidate is a
leak if a stretch of text about as long as the item (a quarter more) has a
longest common subsequence with it of at least SURE of the item, or at least
LIKELY of it with the answer (the item's last fifth) in that stretch. Items of
fewer than SHORT words must be there in full, those of fewer than SEQUENCE word
after word: too short for a vector to tell, they are looked up exactly.

Scale: one pass counts, one pass searches; neither shuffles a text. Only
benchmark blocks of BLOCK passages and their spaces are sent to the executors,
whatever the size of the benchmark, which is taken block by block.

Defined results: words are runs of letters, digits and non-ASCII characters in
lower case; null and empty texts never match, nor do items without a word or with
a null id; rows are judged one by one, so repeated rows and null doc_ids are
fine; rows sharing an item_id are separate texts of one item. An empty corpus or
benchmark gives no leaks; texts of any length are searched whole; other columns,
whatever their names, come back unchanged from without_leaks().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import kernel

PASSAGE = 64
CHUNK = 16
BLOCK = 512
RANK = 160
HELD = 0.6
COSINE = 0.35
SURE, LIKELY, ANSWER = 0.8, 0.65, 0.8
SEQUENCE, SHORT = 5, 8
COMMON = 0.2  # words in more documents than this share carry no weight, unless their passage has few others
FEW = 4
SEED = 5


def _letters() -> np.ndarray:
    keep = np.full(256, 32, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            keep[b] = b
    return keep


_LETTERS = _letters()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the text of each word."""
    raw, begins = kernel.join_texts([t.lower().encode() for t in texts])
    raw = _LETTERS[raw]
    starts, ends = kernel.word_bounds(raw)
    return kernel.word_hashes(raw, starts, ends), np.searchsorted(begins, starts, side="right") - 1


class Lookup:
    """Places of hashes in a sorted table, -1 if absent; most absent ones are ruled out by 18 bits."""

    def __init__(self, table: np.ndarray):
        self.table = np.sort(table)
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.table & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(x & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if len(self.table) and len(maybe):
            at = np.minimum(np.searchsorted(self.table, x[maybe]), len(self.table) - 1)
            hit = self.table[at] == x[maybe]
            out[maybe[hit]] = at[hit]
        return out


def common_subsequence(places: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence of text and an item of n words, a bit of one integer for each; places
    has the bits of every word of the item."""
    full = (1 << n) - 1
    row = full
    for w in text:
        if m := places.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Item:
    """A benchmark item as vocabulary words."""

    def __init__(self, item_id: int, words: np.ndarray, vocabulary: int):
        self.id, self.n = item_id, len(words)
        self.places: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << k
        tail = min(max(3, self.n // 5), self.n)
        self.tail = {w: bits >> (self.n - tail) for w, bits in self.places.items() if bits >> (self.n - tail)}
        self.tail_n = tail
        self.member = np.zeros(vocabulary + 1, bool)  # the last is for words outside the vocabulary
        self.member[words] = True

    def found_share(self, text: np.ndarray) -> float:
        """The largest share of the item in common with a stretch of text (vocabulary words or -1) in which it counts
        as found, else 0. Words that are not the item's can't be in common and are passed over."""
        n = self.n
        least = n if n < SHORT else LIKELY * n
        at = np.flatnonzero(self.member[text])
        if len(at) < least:
            return 0.0
        own = text[at].tolist()
        if common_subsequence(self.places, n, own) < least:
            return 0.0
        step = max(1, n // 8)
        length, best = n + n // 4 + step, 0
        starts = np.arange(0, max(1, len(text) - length + step), step)
        for a, b in zip(np.searchsorted(at, starts).tolist(), np.searchsorted(at, starts + length).tolist()):
            if b - a <= best or b - a < least:
                continue
            part = own[a:b]
            got = common_subsequence(self.places, n, part)
            if got > best and got >= least and (got >= SURE * n or common_subsequence(self.tail, self.tail_n, part) >= ANSWER * self.tail_n):
                best = got
        return best / n


def _counts(docs: DataFrame, text_col: str, lookup: Lookup) -> tuple[int, np.ndarray]:
    """Number of documents, and for each vocabulary word the number of documents with it."""

    def run(batches):
        total, n = np.zeros(len(lookup.table), np.int64), 0
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                words, of = words_of(texts)
                at = lookup(words)
                hit = at >= 0
                pairs = np.unique(of[hit] * np.int64(len(total)) + at[hit])
                total += np.bincount(pairs % max(len(total), 1), minlength=len(total))[: len(total)]
                n += len(texts)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(lookup.table), np.int64), 0
    for r in rows:  # one row for each word of the block at most
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return n, out


def _pieces(column, size: int = 1 << 20):
    """Texts of a column in lists of about size characters."""
    held, n = [], 0
    for x in column:
        held.append(x.as_py() or "")
        n += len(held[-1])
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _rows_times(table: DataFrame, features: int, right: np.ndarray) -> np.ndarray:
    """A'(A right) for the sparse matrix A whose rows are table(at array<int>, x array<double>)."""
    width = right.shape[1]

    def run(batches):
        total = np.zeros((features, width))
        for batch in batches:
            for at, x in zip(batch.column(0), batch.column(1)):
                at, x = np.asarray(at.values), np.asarray(x.values)
                total[at] += x[:, None] * (x @ right[at])[None, :]
        rows = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(total[rows]), pa.list_(pa.float64()))], names=["row", "x"])

    def add(t: pa.Table) -> pa.Table:
        x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, width).sum(0)
        return pa.table({"row": t.column("row")[:1], "x": pa.array([x], pa.list_(pa.float64()))})

    found = table.select("at", "x").mapInArrow(run, "row long, x array<double>").groupBy("row").applyInArrow(add, "row long, x array<double>").toArrow()
    out = np.zeros((features, width))
    if found.num_rows:
        out[found.column("row").to_numpy()] = np.asarray(found.column("x").combine_chunks().flatten()).reshape(-1, width)
    return out


def latent_space(table: DataFrame, features: int, rank: int = RANK, power: int = 2) -> np.ndarray:
    """Right singular vectors (features, up to rank) of the passage matrix, by randomised range finding."""
    rng = np.random.default_rng(SEED)
    rank = min(rank, features)
    q = np.linalg.qr(rng.normal(size=(features, min(rank + 8, features))))[0]
    for _ in range(power + 1):
        q = np.linalg.qr(_rows_times(table, features, q))[0]
    small = q.T @ _rows_times(table, features, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return q @ turn[:, order[values[order] > 1e-9 * max(values.max(), 1e-300)]]


class Searcher:
    """One block of the benchmark, ready to be held against texts."""

    def __init__(self, items, passages, lookup, weight, spaces, exact=()):
        self.passages, self.lookup = passages, lookup
        #: Short items by length, then by the hash of their words.
        self.exact: dict[int, dict[int, list]] = {}
        for i, w in exact:
            self.exact.setdefault(len(w), {}).setdefault(int(kernel.ngram_hashes(w, len(w))[0]), []).append((i, w))
        self.items = [Item(i, lookup(w), len(lookup.table)) for i, w in items]
        self.weighted = weight > 0
        self.spaces = [(v * weight[:, None]).astype(np.float32) for v, _ in spaces]
        self.sought = [[self._group(space, own, size) for size in (2, 4, 8)] for space, (_, own) in zip(self.spaces, spaces)]

    def _group(self, space, own, size):
        """Passages whose windows have that many chunks, their unit vectors and their norms."""
        mine = [p for p in own if (size == 2 or len(self.passages[p][1]) > CHUNK * size // 4) and (len(self.passages[p][1]) <= CHUNK * size // 2 or size == 8)]
        vectors = np.zeros((len(mine), space.shape[1]), np.float32)
        for k, p in enumerate(mine):
            at = self.lookup(self.passages[p][1])
            vectors[k] = space[at[at >= 0]].sum(0)
        norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        return np.array(mine, np.int64), (vectors / norms[:, None]).T.copy(), norms

    def leaks(self, texts: list[str]):
        """(text, item, share in common, cosine) of every leak."""
        words, of = words_of(texts)
        if not len(words):
            return []
        short = self._sequences(words, of)
        if not self.passages:
            return [(d, i, 1.0, 1.0) for d, i in short]
        sizes = np.bincount(of, minlength=len(texts))
        first = np.cumsum(sizes) - sizes
        chunks = -(-sizes // CHUNK)
        chunk_first = np.cumsum(chunks) - chunks
        at = self.lookup(words)
        hit = np.flatnonzero(at >= 0)
        hit = hit[self.weighted[at[hit]]]
        chunk = chunk_first[of[hit]] + (hit - first[of[hit]]) // CHUNK
        doc = np.repeat(np.arange(len(texts)), chunks)
        place = np.arange(len(doc)) - chunk_first[doc]
        found = set()
        if len(hit):
            full, edge = np.unique(chunk, return_index=True)
            for space, groups in zip(self.spaces, self.sought):
                sums = np.zeros((len(doc) + 8, space.shape[1]), np.float32)
                for a in range(0, len(full), 4096):
                    b = min(a + 4096, len(full))
                    stop = edge[b] if b < len(full) else len(hit)
                    sums[full[a:b]] = np.add.reduceat(space[at[hit[edge[a] : stop]]], edge[a:b] - edge[a], axis=0)
                owner = np.append(doc, np.arange(-1, -9, -1))
                for size, (mine, vectors, norms) in zip((2, 4, 8), groups):
                    half = size // 2
                    sums[:-half] += sums[half:] * (owner[half:] == owner[:-half])[:, None]
                    if not len(mine):
                        continue
                    window = np.flatnonzero(place % half == 0)
                    for a in range(0, len(window), 8192):
                        own = window[a : a + 8192]
                        norm = np.linalg.norm(sums[own], axis=1)
                        enough = norm >= COSINE * norms.min()
                        own, norm = own[enough], norm[enough]
                        cosine = sums[own] @ vectors / np.maximum(norm[:, None], norms[None, :])
                        for i, j in zip(*np.nonzero(cosine >= COSINE)):
                            found.add((int(doc[own[i]]), int(place[own[i]]) * CHUNK, size * CHUNK, int(mine[j]), round(float(cosine[i, j]), 6)))
        best: dict[tuple[int, int], tuple] = {}
        for d, start, length, p, cosine in sorted(found, key=lambda x: -x[4]):
            item = self.items[self.passages[p][0]]
            if (d, item.id) in best:
                continue
            text = at[first[d] : first[d] + sizes[d]][max(0, start - item.n) : start + length + item.n]
            if share := item.found_share(text):
                best[d, item.id] = (share, cosine)
        for d, i in short:
            best[d, i] = max(best.get((d, i), (0, 0)), (1.0, 1.0))
        return [(d, i, *x) for (d, i), x in best.items()]

    def _sequences(self, words: np.ndarray, of: np.ndarray) -> set:
        """(text, item) of every short item that is in a text word after word."""
        found = set()
        for n, items in self.exact.items():
            grams = kernel.ngram_hashes(words, n)
            for at in np.flatnonzero(np.isin(grams, np.fromiter(items, np.uint64, len(items)))).tolist():
                if of[at] == of[at + n - 1]:
                    found.update((int(of[at]), i) for i, w in items[int(grams[at])] if np.array_equal(w, words[at : at + n]))
        return found


def searchers(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"):
    """A Searcher for each block of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # Blocks hold about BLOCK passages each, by the number of bytes, as no passage of 64 words has fewer than 128.
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_blocks = max(1, -(-(size["n"] + (size["b"] or 0) // (2 * PASSAGE)) // (4 * BLOCK)))
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).orderBy("id", "text").collect()
        hashes, of = words_of([r["text"] for r in rows])
        held = [(r["id"], hashes[of == k]) for k, r in enumerate(rows)]
        exact = [(i, w) for i, w in held if 0 < len(w) < SEQUENCE]
        held = [(i, w) for i, w in held if len(w) >= SEQUENCE]
        passages = []
        for k, (_, w) in enumerate(held):
            n = -(-len(w) // PASSAGE)
            passages += [(k, part) for part in np.array_split(w, n)]
        if not passages:
            if exact:
                yield Searcher([], [], Lookup(np.empty(0, np.uint64)), np.empty(0), [], exact)
            continue
        lookup = Lookup(np.unique(np.concatenate([p for _, p in passages])))
        n_docs, df = _counts(docs, text_col, lookup)
        weight = np.log((2 + n_docs) / (1 + df))
        rare = df <= COMMON * n_docs
        for _, p in passages:  # a passage of common words alone keeps them
            at = np.unique(lookup(p))
            if rare[at].sum() < FEW:
                rare[at] = True
        weight = np.where(rare, np.maximum(weight, 1e-3), 0.0)
        yield Searcher(held, passages, lookup, weight, _spaces(spark, passages, lookup, weight), exact)


def _spaces(spark, passages, lookup, weight):
    """Latent spaces, with the passages each is searched for."""
    left, out = list(range(len(passages))), []
    vectors = {}
    for p in left:
        at, tf = np.unique(lookup(passages[p][1]), return_counts=True)
        vectors[p] = at[weight[at] > 0], (tf * weight[at])[weight[at] > 0]
    while left:
        rows = pa.table({"at": pa.array([vectors[p][0].tolist() for p in left], pa.list_(pa.int32())), "x": pa.array([vectors[p][1].tolist() for p in left], pa.list_(pa.float64()))})
        v = latent_space(spark.createDataFrame(rows), len(weight))
        share = np.array([np.linalg.norm(x @ v[at]) ** 2 / max(x @ x, 1e-300) for at, x in (vectors[p] for p in left)])
        enough = share >= min(HELD, share.max())
        out.append((v, [p for p, e in zip(left, enough) if e]))
        left = [p for p, e in zip(left, enough) if not e]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, lcs_share, cosine."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names, kinds = ["doc_id", "item_id", "lcs_share", "cosine"], (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    schema = "doc_id long, item_id long, lcs_share double, cosine double"
    out = None
    for searcher in searchers(docs, benchmark, text_col):

        def run(batches, searcher=spark.sparkContext.broadcast(searcher)):
            for batch in batches:
                ids, at = batch.column(0), 0
                for texts in _pieces(batch.column(1)):
                    found = [(ids[at + d].as_py(), i, s, c) for d, i, s, c in searcher.value.leaks(texts)]
                    at += len(texts)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark item is found, columns unchanged. No join, no shuffle."""
    spark, kind = docs.sparkSession, docs.schema
    whole, at_text = docs, docs.columns.index(text_col)
    for searcher in searchers(whole, benchmark, text_col):

        def run(batches, searcher=spark.sparkContext.broadcast(searcher)):
            for batch in batches:
                keep, at = np.ones(batch.num_rows, bool), 0
                for texts in _pieces(batch.column(at_text)):
                    for d, *_ in searcher.value.leaks(texts):
                        keep[at + d] = False
                    at += len(texts)
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, kind)
    return docs
