"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its SHINGLE-word shingles (one shingle of all its
words if it has fewer). Each element runs a Poisson process over its weight,
discretised to the whole numbers and cut into dyadic intervals: a point has a
time, a signature component and a weight level, and counts for a bag that holds
the element more often than that level. A component keeps its earliest point,
so two bags agree on it with the probability of their weighted Jaccard
similarity. Points are made in the order of time, only up to the bound that
fills the signature.

Two documents of similarity THRESHOLD share one of the bands with a probability
of 0.99997. Documents that share one are linked where the overlap of their
whole multisets confirms it. Copies are folded into one first. Within a band's
group all are compared with its smallest id, which then leaves. In groups that
still hold several classes, every document outside the largest class is held
against all of other classes: by pairs in groups of at most SMALL, else block by
block on signatures, first for the likeliest link of each, then for all, so no
link depends on a cap. Groups with over DIVIDED such documents are first cut by
each later band and the likeliest links of the parts merged, which leaves fewer
to hold against in full.
Only pairs whose signatures agree as those of THRESHOLD do, less four standard
deviations, are read and compared in full; within blocks, also only those that
the counts of shingles in PROFILE slots, which bound the overlap from above,
leave possible.

Scale: a document's places in bands stay in one row with its id, so labels,
signatures and profiles are joined once a document, however many groups it is
in; only rows of ids are dealt by group. Groups are counted by partial sums.

Defined results: words are runs of bytes other than space and 0x09-0x0D; null,
empty and blank texts are never duplicates; rows with equal doc_id are one
document; a null doc_id is in no class (null class_id). class_id is the
smallest doc_id of the class. An empty table gives no rows. Texts of any length
are read whole, one at a time beyond 3 MB. Other columns, whatever their names,
are not looked at and come back unchanged from one_of_each().
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import kernel
from vecloom.llm.graph import components
from vecloom.llm.store import dropped, narrowed, small_batches, tidied, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
SIZE = BANDS * ROWS
SMALL, DIVIDED = 24, 4096
#: Rows of a block of a group, on either side.
BLOCK = 1024
PROFILE = 512


def shingles(texts: list[bytes], n: int = SHINGLE):
    """Distinct shingle hashes of each text with their counts: (hashes, counts, text of each)."""
    raw, begins = kernel.join_texts(texts)
    starts, ends = kernel.word_bounds(raw)
    doc = np.searchsorted(begins, starts, side="right") - 1
    words = kernel.word_hashes(raw, starts, ends)
    size = np.bincount(doc, minlength=len(texts))
    grams = kernel.ngram_hashes(words, n)
    inside = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :][: len(grams)]) if len(grams) else np.empty(0, np.int64)
    grams, of = grams[inside], doc[inside]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        first = np.cumsum(size) - size
        whole = [kernel.ngram_hashes(words[first[d] : first[d] + size[d]], int(size[d]))[0] ^ np.uint64(size[d]) for d in short]
        grams, of = np.append(grams, np.array(whole, np.uint64)), np.append(of, short)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return grams[at], np.diff(np.append(at, len(grams))), of[at]


def signatures(grams: np.ndarray, counts: np.ndarray, of: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures, one row of 64-bit point names for each document (zeros where it has no element)."""
    out = np.zeros((n_docs, size), np.uint64)
    total = np.bincount(of, weights=counts, minlength=n_docs)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n_docs)
    limit[todo] = (np.log(size) + 3) / total[todo]
    while len(todo):
        mine = np.zeros(n_docs, bool)
        mine[todo] = True
        best = np.full(n_docs * size, np.inf)
        points = []
        level, low = 0, 0
        own = np.flatnonzero(mine[of])
        while len(own):  # the dyadic interval [low, low + width) of the weights of elements that reach it
            width = max(1, low)
            g, w, d = grams[own], counts[own], of[own]
            seed = kernel.mix(g + np.uint64(0x632BE59BD9B4E019 * (level + 1) & (1 << 64) - 1))
            t, k = np.zeros(len(g)), 0
            while len(g):
                k += 1
                u = (kernel.mix(seed + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64)
                t = t - np.log((u + 0.5) / 2.0**53) / (size * width)
                live = t <= limit[d]
                g, w, d, seed, t = g[live], w[live], d[live], seed[live], t[live]
                name = kernel.mix(seed ^ np.uint64(k * 0xD1B54A32D192ED03 & (1 << 64) - 1))
                part = (name % np.uint64(size)).astype(np.int64)
                if width == 1:
                    take = slice(None)
                else:
                    take = low + (kernel.mix(name) >> np.uint64(11)).astype(np.float64) / 2.0**53 * width // 1 < w
                key = (d * size + part)[take]
                np.minimum.at(best, key, t[take])
                points.append((key, t[take], name[take]))
            level, low = level + 1, max(1, low * 2)
            own = own[counts[own] > low]
        for key, t, name in points:
            first = t == best[key]
            out.reshape(-1)[key[first]] = name[first]
        filled = np.isfinite(best.reshape(n_docs, size)[todo]).all(1)
        todo = todo[~filled]
        limit[todo] *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    out = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = kernel.mix(out * np.uint64(0xD1342543DE82EF95) + sig[:, r::rows][:, :bands])
    return out


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, counts)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(a[0]) or len(b[0]) else 0.0


def _signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1 and k2 (a 128-bit name of the multiset), n (its size), bands, sketch (16 bits of each component); no
    bands without words."""

    def run(batches):
        for batch in batches:
            at, held, size = 0, [], 0
            for k, text in enumerate(batch.column(1)):
                held.append((text.as_py() or "").encode())
                size += len(held[-1])
                if size > 3 << 20 or len(held) == 1000 or k == batch.num_rows - 1:
                    yield one(batch.column(0)[at : k + 1], held)
                    at, held, size = k + 1, [], 0

    def one(ids, texts):
        grams, counts, of = shingles(texts)
        sig = signatures(grams, counts, of, len(texts))
        bands = band_hashes(sig).view(np.int64)
        sketch = np.ascontiguousarray((sig >> np.uint64(13)).astype(np.uint16))
        n = np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)
        edge = np.searchsorted(of, np.arange(len(texts) + 1))
        names = [hashlib.blake2b(grams[a:b].tobytes() + counts[a:b].astype(np.int64).tobytes(), digest_size=16).digest() for a, b in zip(edge, edge[1:])]
        pair = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))), pa.int32()), pa.array(bands[n > 0].ravel()))
        return pa.RecordBatch.from_arrays([ids, pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n), cells, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "k1", "k2", "n", "bands", "sketch"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, k1 long, k2 long, n long, bands array<long>, sketch binary")


def _least(threshold: float) -> float:
    """Components in which signatures of similar documents agree, four standard deviations off."""
    return threshold * SIZE - 4 * (SIZE * threshold * (1 - threshold)) ** 0.5


def _profiles(rows: DataFrame) -> DataFrame:
    """(doc_id, profile): how many shingles of each text fall in each slot, as 16-bit counts (larger ones count as full)."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                grams, counts, _ = shingles([x.as_py().encode()])
                slots = np.bincount((grams >> np.uint64(40)).astype(np.int64) % PROFILE, weights=counts, minlength=PROFILE)
                out.append(np.minimum(slots, 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "profile"])

    return rows.mapInArrow(tidied(run), "doc_id long, profile binary")


def _possible(a: np.ndarray, b: np.ndarray, na: int, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the profiles (b one a row) leave room for a weighted Jaccard similarity of threshold."""
    full = (a == 65535) & (b == 65535)
    most = np.minimum(a.astype(np.int64), b).sum(1)
    return full.any(1) | (most * (1 + threshold) >= threshold * (na + nb) - 1e-6)


def _held_against(docs: DataFrame, threshold: float, likeliest: bool) -> DataFrame:
    """(u, v) of documents of a group in different classes, one outside its largest, that may be similar by signature
    and profile.

    docs(doc_id, n, label, sketch, profile, places of key, m, others and outside); likeliest: for each document
    outside, the best in each block alone.
    """
    least = _least(threshold)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        (a, na, la, sa, pa_), (b, nb, lb, sb, pb) = (
            (*(t.column(c).to_numpy() for c in ("doc_id", "n", "label")), *(np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(t.num_rows, -1) for c in ("sketch", "profile")))
            for t in (left, right)
        )
        u, v = [], []
        for i in range(len(a)):
            agree = np.where(lb != la[i], (sb == sa[i]).sum(1), 0)
            hit = np.flatnonzero(agree >= least)
            hit = hit[_possible(pa_[i], pb[hit], na[i], nb[hit], threshold)]
            if likeliest and len(hit):
                hit = hit[[agree[hit].argmax()]]
            u.append(np.minimum(a[i], b[hit]))
            v.append(np.maximum(a[i], b[hit]))
        return pa.table({"u": pa.array(np.concatenate(u)), "v": pa.array(np.concatenate(v))})

    def parts(n):
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def share(n):
        return F.pmod(F.xxhash64("doc_id"), parts(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), parts(n) - 1))

    rows = docs.select("doc_id", "n", "label", "sketch", "profile", F.inline("places"))
    outside = rows.where("outside").withColumn("chunk", share("others")).withColumn("block", every("m")).select("key", "block", "chunk", "doc_id", "n", "label", "sketch", "profile")
    inside = rows.withColumn("block", share("m")).withColumn("chunk", every("others"))
    inside = inside.select(*[F.col(c).alias(f"{c}_") for c in ("key", "block", "chunk")], *[F.col(c).alias(c) for c in ("doc_id", "n", "label", "sketch", "profile")])
    return outside.groupBy("key", "block", "chunk").cogroup(inside.groupBy("key_", "block_", "chunk_")).applyInArrow(compare, "u long, v long")


def _plausible(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose signatures agree in as many components as those of similar documents do."""
    least = _least(threshold)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, SIZE) for c in batch.columns[2:])
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array((a == b).sum(1) >= least))

    right = pairs.join(sketches.select(F.col("doc_id").alias("v"), F.col("sketch").alias("b")), "v")
    both = right.join(sketches.select(F.col("doc_id").alias("u"), F.col("sketch").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(tidied(run), "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose whole multisets are similar enough."""

    def run(batches):
        known: OrderedDict = OrderedDict()  # of texts met lately

        def bag(key, text):
            if key not in known:
                grams, counts, _ = shingles([text.encode()])
                known[key] = grams, counts
                if len(known) > 64:
                    known.popitem(last=False)
            return known[key]

        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                u, v, a, b = (c[k].as_py() for c in batch.columns)
                keep.append(overlap(bag((u, len(a)), a), bag((v, len(b)), b)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    right = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    both = right.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(tidied(run), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, class_id (the smallest doc_id of its class)."""
    spark = df.sparkSession
    small_batches(spark)
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    signed = written(_signed(df, id_col, text_col), "minhash-signed")
    bags = signed.where("n > 0 and doc_id is not null")
    # One row for each distinct multiset, by its smallest id; its copies are linked to that.
    single = kept(bags.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("s")).select("k1", "k2", "s.*"), "minhash-single")
    copies = kept(bags.join(single.select("k1", "k2", F.col("doc_id").alias("rep")), ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "minhash-copies")
    sketches = single.select("doc_id", "sketch")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("id"))

    labels: DataFrame | None = None

    def learn(pairs: DataFrame) -> None:
        """Compares pairs and merges the classes of those that are similar: labels has the class of each document in one of several."""
        nonlocal labels
        pairs = kept(pairs.distinct(), "minhash-pairs")
        near = kept(_plausible(pairs, narrowed(sketches, "doc_id", ends(pairs), "id"), threshold), "minhash-near")
        links = _verified(near, narrowed(rows, "doc_id", ends(near), "id"), threshold)
        if labels is not None:
            links = links.unionByName(labels.select(F.col("doc_id").alias("u"), F.col("label").alias("v")))
        labels = kept(components(links, "minhash-merge").select(F.col("node").alias("doc_id"), F.col("root").alias("label")), "minhash-labels")

    def labelled(docs: DataFrame) -> DataFrame:
        return docs.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    placed = single.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))
    hubs = kept(placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "n")).alias("h")).where("m > 1").select("key", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("hub_n")), "minhash-hubs")
    met = narrowed(placed, "key", hubs, "key").join(hubs, "key").where(F.col("doc_id") != F.col("hub"))
    # From here on a row a document, with its places in groups.
    members = kept(met.groupBy("doc_id", "n").agg(F.collect_list(F.struct("key", "band", "hub", "hub_n")).alias("places")), "minhash-members")
    starred = members.select("doc_id", "n", F.inline("places")).where(F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n") - 1e-9)
    learn(starred.select(F.col("hub").alias("u"), F.col("doc_id").alias("v")))

    def mixed(docs: DataFrame) -> DataFrame:
        """docs(doc_id, n, places of key and band), with labels, in those groups alone that hold several classes; for each
        place the members of its group, how many are outside the largest class, and whether the document is."""
        places = labelled(docs).select("doc_id", "n", "label", F.inline("places")).select("doc_id", "n", "label", "key", "band")
        shares = places.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("m"))
        several = kept(shares.where("m > top.size").select("key", "m", F.col("top.label").alias("main"), (F.col("m") - F.col("top.size")).alias("others")), "minhash-several")
        found = narrowed(places, "key", several, "key").join(several, "key")
        place = F.struct("key", "band", "m", "others", (F.col("label") != F.col("main")).alias("outside"))
        return kept(found.groupBy("doc_id", "n", "label").agg(F.collect_list(place).alias("places")), "minhash-mixed")

    def only(docs: DataFrame, test) -> DataFrame:
        """docs with the places that pass, if any do."""
        return docs.withColumn("places", F.filter("places", test)).where(F.size("places") > 0)

    def settle(docs: DataFrame, known: DataFrame, likeliest: bool) -> DataFrame:
        """Members of different classes to be compared: all in small groups, in others all or each with its likeliest."""
        few = only(docs, lambda p: p["m"] <= SMALL).select("doc_id", "n", "label", F.inline("places"))
        a = few.select("key", F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu"))
        b = few.select("key", F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("label").alias("lv"))
        close = F.least("nu", "nv") >= threshold * F.greatest("nu", "nv") - 1e-9
        pairs = a.join(b, "key").where((F.col("u") < F.col("v")) & (F.col("lu") != F.col("lv")) & close).select("u", "v")
        return pairs.unionByName(_held_against(only(docs, lambda p: p["m"] > SMALL).join(known, "doc_id"), threshold, likeliest))

    def profiled(docs: DataFrame) -> DataFrame:
        """Signatures and profiles of documents in groups of more than SMALL."""
        ids = only(docs, lambda p: p["m"] > SMALL).select("doc_id").distinct()
        return kept(narrowed(sketches, "doc_id", ids, "doc_id").join(_profiles(narrowed(rows, "doc_id", ids, "doc_id")), "doc_id"), "minhash-profiles")

    named = mixed(members)
    if not named.isEmpty():
        known = profiled(named)
        large = only(named, lambda p: p["others"] > DIVIDED)
        if not large.isEmpty():
            # Merges only: the groups themselves are compared below whatever their parts by each later band gave.
            bands = single.select("doc_id", "n", "bands")
            cut = F.flatten(F.transform("places", lambda p: F.transform(F.slice("bands", p["band"] + 2, BANDS), lambda k: F.struct(F.xxhash64(p["key"], k).alias("key"), p["band"].alias("band")))))
            finer = large.select("doc_id", "n", "places").join(bands, ["doc_id", "n"]).select("doc_id", "n", cut.alias("places"))
            learn(settle(only(mixed(finer), lambda p: p["others"] <= DIVIDED), known, True))
            named = mixed(members)
        learn(settle(named, known, True))
        many = only(named, lambda p: p["m"] > SMALL)
        if not many.isEmpty():
            # Places keep what was outside before; compared are only those whose classes still differ.
            learn(settle(labelled(many.drop("label")), known, False))
    links = copies.unionByName(labels.select(F.col("doc_id").alias("u"), F.col("label").alias("v")))
    roots = components(links, "minhash-classes")
    dropped(*made)
    return signed.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, columns unchanged, whose document is the first of its class.

    Rows that share the id of such a document stay, as do rows with a null id.
    """
    classes = near_duplicates(df.select(id_col, text_col), id_col, text_col, threshold)
    gone = written(classes.where("doc_id <> class_id").select("doc_id").distinct(), "minhash-gone")
    named = df.where(F.col(id_col).isNotNull())
    kept = named.join(gone, df[id_col].cast("long") == gone["doc_id"], "left_anti")
    return kept.unionByName(df.where(F.col(id_col).isNull()))
