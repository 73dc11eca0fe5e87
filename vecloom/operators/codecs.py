"""Named codecs for embedding vectors.

A codec turns vectors into codes of a fixed number of bytes and scores a query
against codes. Names carry the parameters of the shape:

    f32  int8  binary  binary-centred  binary-hamming  pq[<m>]
    mrl<k>[+<inner>]  mixed[<bytes>][-pca][-w]

Every codec has a NumPy side for blocks (`encode`, `decode`, `scores`, `pack`,
`unpack`) and, where built-in expressions suffice, a Column side (`encode_col`,
`decode_col`). Scores equal the metric on decoded vectors, but for
binary-hamming (an angle estimated from differing bits) and mrl (the prefix
alone is compared for cosine and L2).
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vectors import Metric, VectorError, matrix, score_blocks

#: Vectors that a rotated mixed codec is fitted on, at most, evenly spread over the collection (C14).
FIT_VECTORS = 20_000
#: Max's (1960) step sizes of uniform quantisers of a unit normal, for 1 to 8 bits.
STEPS = (1.596, 0.9957, 0.5860, 0.3352, 0.1881, 0.1041, 0.0569, 0.0308)


class NotFitted(VectorError):
    """A trained codec was used before fit()."""


class Codec:
    """A codec of one dimension; trained ones need fit() or restore() first."""

    name, size, trained = "", 0, False

    def __init__(self, dim: int):
        if dim < 1:
            raise VectorError("dimension must be positive")
        self.dim = dim

    def ready(self) -> None:
        """Raises NotFitted for a trained codec without parameters."""

    def fit(self, sample: np.ndarray) -> "Codec":
        return self

    def fit_frame(self, df: DataFrame, vector_col: str, id_col: str) -> "Codec":
        """fit() over a whole collection."""
        return self

    def params(self) -> bytes:
        return b""

    def restore(self, params: bytes) -> "Codec":
        if params:
            raise VectorError(f"{self.name} has no parameters")
        return self

    def check(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(x, np.float64))
        if x.shape[1] != self.dim:
            raise VectorError(f"{self.name}: {x.shape[1]} dimensions where {self.dim} are due")
        return x

    def encode(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def scores(self, queries: np.ndarray, codes: np.ndarray, metric: Metric) -> np.ndarray:
        return score_blocks(self.check(queries), self.decode(codes), metric)

    def pack(self, codes: np.ndarray) -> list[bytes]:
        """Codes as bytes, each `size` long."""
        return [row.tobytes() for row in np.ascontiguousarray(codes)]

    def unpack(self, blobs: list[bytes]) -> np.ndarray:
        for b in blobs:
            if len(b) != self.size:
                raise VectorError(f"{self.name}: a code of {len(b)} bytes where {self.size} are due")
        return np.frombuffer(b"".join(blobs), self._packed_dtype).reshape(len(blobs), -1)

    _packed_dtype: np.dtype = np.dtype(np.uint8)

    @property
    def compression_ratio(self) -> float:
        return 4 * self.dim / self.size


def _signs(bits: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, bitorder="little")[:, :dim] * 2.0 - 1.0


def _bits(x: np.ndarray) -> np.ndarray:
    return np.packbits(x, axis=1, bitorder="little")


class F32(Codec):
    name = "f32"
    _packed_dtype = np.dtype("<f4")

    def __init__(self, dim):
        super().__init__(dim)
        self.size = 4 * dim

    def encode(self, x):
        return self.check(x).astype("<f4")

    def decode(self, codes):
        return codes.astype(np.float64)

    def encode_col(self, v: Column) -> Column:
        return F.transform(v, lambda x: x.cast("float"))

    def decode_col(self, code: Column) -> Column:
        return code


class Int8(Codec):
    """Per vector: least value, scale and 8-bit steps between, in single precision."""

    name = "int8"

    def __init__(self, dim):
        super().__init__(dim)
        self.size = 8 + dim

    def encode(self, x):
        x = self.check(x).astype(np.float32)
        low, high = x.min(1), x.max(1)
        scale = ((high - low) / np.float32(255)).astype(np.float32)
        scale[scale == 0] = 1
        q = ((x - low[:, None]).astype(np.float32) / scale[:, None]).astype(np.float32)
        q = np.clip(np.floor(q + np.float32(0.5)), 0, 255)
        return np.hstack([low[:, None].view(np.uint8).reshape(len(x), 4), scale[:, None].view(np.uint8).reshape(len(x), 4), q.astype(np.uint8)])

    def decode(self, codes):
        codes = np.ascontiguousarray(codes)
        low, scale = (codes[:, a : a + 4].copy().view("<f4").astype(np.float64) for a in (0, 4))
        return low + codes[:, 8:] * scale

    def encode_col(self, v: Column) -> Column:
        """STRUCT<low FLOAT, scale FLOAT, q ARRAY<SMALLINT>>."""
        low = F.array_min(v).cast("float")
        step = ((F.array_max(v).cast("float") - low) / F.lit(255.0).cast("float")).cast("float")
        scale = F.when(step == 0, F.lit(1.0).cast("float")).otherwise(step)
        q = F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(((x.cast("float") - low).cast("float") / scale).cast("float") + F.lit(0.5).cast("float")).cast("int"))).cast("smallint"))
        return F.struct(low.alias("low"), scale.alias("scale"), q.alias("q"))

    def decode_col(self, code: Column) -> Column:
        return F.transform(code["q"], lambda q: code["low"].cast("double") + q * code["scale"].cast("double"))


class Binary(Codec):
    """One sign bit a dimension; decodes to +-1/sqrt(dim)."""

    name = "binary"

    def __init__(self, dim):
        super().__init__(dim)
        self.size = -(-dim // 8)

    def encode(self, x):
        return _bits(self.check(x) > 0)

    def decode(self, codes):
        return _signs(codes, self.dim) / np.sqrt(self.dim)

    def encode_col(self, v: Column) -> Column:
        """ARRAY<BIGINT>: 64 sign bits a word, lowest first."""
        words = [
            F.aggregate(F.slice(v, a + 1, min(64, self.dim - a)), F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).alias("i")), lambda s, x: F.struct((s["w"].bitwiseOR(F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), s["i"])).otherwise(F.lit(0).cast("bigint")))).alias("w"), (s["i"] + 1).alias("i")), lambda s: s["w"])
            for a in range(0, self.dim, 64)
        ]
        return F.array(*words)

    def decode_col(self, code: Column) -> Column:
        one = 1 / np.sqrt(self.dim)
        return F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.when(F.call_function("shiftrightunsigned", F.get(code, (i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(one)).otherwise(F.lit(-one)))


class BinaryHamming(Binary):
    """The same bits, compared with the query's own: cos(pi * differing / dim)."""

    name = "binary-hamming"

    def differing(self, queries, codes):
        def words(x):  # 64 bits each, the last filled up
            x = np.ascontiguousarray(np.pad(x, ((0, 0), (0, -x.shape[1] % 8))))
            return x.view(np.uint64)

        q, c = words(_bits(self.check(queries) > 0)), words(np.asarray(codes, np.uint8))
        out = np.zeros((len(q), len(c)), np.uint16)
        for k in range(q.shape[1]):
            out += np.bitwise_count(q[:, k, None] ^ c[None, :, k])
        return out

    def scores(self, queries, codes, metric):
        near = np.cos(np.pi * np.arange(self.dim + 1) / self.dim)
        return (2 - 2 * near if metric is Metric.L2 else near)[self.differing(queries, codes)]

    def score_col(self, query_code: Column, code: Column, metric: Metric) -> Column:
        differ = F.aggregate(F.zip_with(query_code, code, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        near = F.cos(F.lit(np.pi) * differ / F.lit(self.dim))
        return F.lit(2.0) - 2 * near if metric is Metric.L2 else near


class BinaryCentred(Binary):
    """Sign bits around the collection's mean; decodes to mean +- alpha."""

    name, trained = "binary-centred", True
    mean: np.ndarray | None = None
    alpha = 0.0

    def ready(self):
        if self.mean is None:
            raise NotFitted(self.name)

    def fit(self, sample):
        sample = self.check(sample)
        if not len(sample):
            raise VectorError("nothing to fit on")
        return self._set(sample.mean(0).astype(np.float32), np.float32(np.abs(sample - sample.mean(0).astype(np.float32)).mean()))

    def fit_frame(self, df: DataFrame, vector_col: str, id_col: str = "vec_id") -> "BinaryCentred":
        """The fit over a whole collection, as aggregates; one row of numbers comes to the driver."""
        rows = df.select(F.posexplode(vector_col).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).cast("float").alias("m"))
        mean = np.array([r["m"] for r in rows.orderBy("i").collect()], np.float32)
        away = F.aggregate(F.zip_with(vector_col, F.lit(mean.tolist()).cast("array<float>"), lambda x, m: F.abs(x.cast("double") - m.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        alpha = df.agg((F.sum(away) / (F.count(F.lit(1)) * self.dim)).alias("a")).first()["a"]
        return self._set(mean, np.float32(alpha))

    def _set(self, mean, alpha):
        self.mean, self.alpha = np.asarray(mean, np.float32), np.float32(alpha)
        return self

    def params(self):
        self.ready()
        return np.append(self.mean, self.alpha).astype("<f4").tobytes()

    def restore(self, params):
        x = np.frombuffer(params, "<f4") if len(params) % 4 == 0 else np.empty(0)
        if len(x) != self.dim + 1 or not np.isfinite(x).all():
            raise VectorError(f"{self.name}: bad parameters")
        return self._set(x[:-1], x[-1])

    def encode(self, x):
        self.ready()
        return _bits(self.check(x) > self.mean.astype(np.float64))

    def decode(self, codes):
        self.ready()
        return self.mean.astype(np.float64) + float(self.alpha) * _signs(codes, self.dim)

    def encode_col(self, v: Column) -> Column:
        self.ready()
        return super().encode_col(F.zip_with(v, F.lit(self.mean.tolist()).cast("array<float>"), lambda x, m: x.cast("double") - m.cast("double")))

    def decode_col(self, code: Column) -> Column:
        self.ready()
        unit = super().decode_col(code)
        return F.zip_with(unit, F.lit(self.mean.astype(float).tolist()).cast("array<double>"), lambda s, m: m + F.lit(float(self.alpha)) * F.signum(s))


class PQ(Codec):
    """m subspaces of dim / m, each coded by its nearest of up to 256 centroids."""

    trained, rounds = True, 20
    centroids: np.ndarray | None = None

    def __init__(self, dim, m):
        super().__init__(dim)
        if m < 1 or dim % m:
            raise VectorError(f"pq: {dim} dimensions cannot be cut into {m} subspaces")
        self.m, self.size, self.name = m, m, f"pq{m}"

    def ready(self):
        if self.centroids is None:
            raise NotFitted(self.name)

    def parts(self, x):
        return x.reshape(len(x), self.m, self.dim // self.m).transpose(1, 0, 2)

    @staticmethod
    def nearest(x, centroids):
        """Lowest index on ties."""
        out = np.empty(len(x), np.int64)
        for a in range(0, len(x), 4096):
            b = x[a : a + 4096]
            out[a : a + 4096] = ((b[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)
        return out

    @classmethod
    def cluster(cls, x):
        """Lloyd's rounds from evenly spread starts; an empty cluster keeps its centroid."""
        x = x.astype(np.float32)
        n = len(x)
        k = min(256, n)
        centroids, last = x[np.arange(k) * n // k].copy(), None
        for _ in range(cls.rounds):
            at = cls.nearest(x, centroids)
            if last is not None and (at == last).all():
                break
            last = at
            count = np.bincount(at, minlength=k)
            sums = np.zeros((k, x.shape[1]))
            np.add.at(sums, at, x.astype(np.float64))
            full = count > 0
            centroids[full] = (sums[full] / count[full, None]).astype(np.float32)
        return centroids

    def fit(self, sample):
        sample = self.check(sample)
        if not len(sample):
            raise VectorError("nothing to fit on")
        self.centroids = np.stack([self.cluster(p) for p in self.parts(sample)])
        return self

    def fit_frame(self, df: DataFrame, vector_col: str, id_col: str) -> "PQ":
        """The same rounds over a whole collection in the order of id_col: each sums the vectors of every centroid, and
        the driver gets a row a centroid."""
        from vecloom.operators.retrieval import even_sample

        rows = df.select(id_col, vector_col)
        starts = matrix(even_sample(rows, 256, id_col).orderBy(id_col).toArrow().column(vector_col))
        if not len(starts):
            raise VectorError("nothing to fit on")
        centroids = np.stack(list(self.parts(self.check(starts).astype(np.float32))))
        sub, k = self.dim // self.m, len(starts)
        names = [f"s{i}" for i in range(sub)]

        def run(batches, centroids):
            count, sums = np.zeros(self.m * k, np.int64), np.zeros((self.m * k, sub))
            for batch in batches:
                if batch.num_rows:
                    x = self.check(matrix(batch.column(0))).astype(np.float32)
                    for j, part in enumerate(self.parts(x)):
                        at = j * k + self.nearest(part, centroids[j])
                        count += np.bincount(at, minlength=self.m * k)
                        np.add.at(sums, at, part.astype(np.float64))
            full = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(count[full]), *[pa.array(c) for c in sums[full].T]], names=["at", "n", *names])

        for _ in range(self.rounds):
            part = df.select(vector_col).mapInArrow(lambda batches, c=centroids: run(batches, c), "at long, n long, " + ", ".join(f"{c} double" for c in names))
            t = part.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
            moved = centroids.reshape(-1, sub).copy()
            moved[t.column("at").to_numpy()] = np.stack([t.column(c).to_numpy() for c in names], 1) / t.column("n").to_numpy()[:, None]
            moved = moved.reshape(centroids.shape)
            if (moved == centroids).all():
                break
            centroids = moved
        self.centroids = centroids
        return self

    def params(self):
        self.ready()
        return struct.pack("<3I", *self.centroids.shape) + self.centroids.astype("<f4").tobytes()

    def restore(self, params):
        if len(params) < 12:
            raise VectorError(f"{self.name}: bad parameters")
        shape = struct.unpack("<3I", params[:12])
        x = np.frombuffer(params[12:], np.uint8)
        if shape[0] != self.m or shape[2] != self.dim // self.m or not 1 <= shape[1] <= 256 or len(x) != 4 * np.prod(shape):
            raise VectorError(f"{self.name}: bad parameters")
        self.centroids = np.frombuffer(params[12:], "<f4").reshape(shape).copy()
        if not np.isfinite(self.centroids).all():
            raise VectorError(f"{self.name}: bad parameters")
        return self

    def encode(self, x):
        self.ready()
        x = self.check(x).astype(np.float32)
        return np.stack([self.nearest(p, c) for p, c in zip(self.parts(x), self.centroids)], 1).astype(np.uint8)

    def decode(self, codes):
        self.ready()
        if codes.size and codes.max() >= self.centroids.shape[1]:
            raise VectorError(f"{self.name}: a code names no centroid")
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centroids)], 1).astype(np.float64)


class Truncated(Codec):
    """The first k dimensions through an inner codec; decodes with zeros behind."""

    def __init__(self, dim, k, inner: Codec, suffix: str = ""):
        super().__init__(dim)
        self.k, self.inner = k, inner
        self.size, self.trained, self.name = inner.size, inner.trained, f"mrl{k}{suffix}"
        self._packed_dtype = inner._packed_dtype

    def ready(self):
        self.inner.ready()

    def fit(self, sample):
        self.inner.fit(self.check(sample)[:, : self.k])
        return self

    def fit_frame(self, df: DataFrame, vector_col: str, id_col: str) -> "Truncated":
        self.inner.fit_frame(df.select(id_col, F.slice(vector_col, 1, self.k).alias(vector_col)), vector_col, id_col)
        return self

    def params(self):
        return self.inner.params()

    def restore(self, params):
        self.inner.restore(params)
        return self

    def encode(self, x):
        return self.inner.encode(self.check(x)[:, : self.k])

    def decode(self, codes):
        out = np.zeros((len(codes), self.dim))
        out[:, : self.k] = self.inner.decode(codes)
        return out

    def scores(self, queries, codes, metric):
        return self.inner.scores(self.check(queries)[:, : self.k], codes, metric)

    def pack(self, codes):
        return self.inner.pack(codes)

    def unpack(self, blobs):
        return self.inner.unpack(blobs)

    def encode_col(self, v: Column) -> Column:
        return self.inner.encode_col(F.slice(v, 1, self.k))

    def decode_col(self, code: Column) -> Column:
        return F.concat(self.inner.decode_col(code), F.array_repeat(F.lit(0.0), self.dim - self.k))


def allocate(variance, n_bits: int) -> np.ndarray:
    """Bits a dimension: the n_bits largest of variance / 4**level over dimensions and levels 0 to 7, ties to the lower
    dimension. As gains fall with the level, that is what taking one bit at a time would give."""
    variance = np.asarray(variance, float)
    gain = variance[:, None] / 4.0 ** np.arange(8)[None, :]
    dim, level = np.divmod(np.arange(gain.size), 8)
    order = np.lexsort((level, dim, -gain.ravel()))[: min(n_bits, gain.size)]
    return np.bincount(dim[order], minlength=len(variance))


class Mixed(Codec):
    """Uniform quantisers around the mean, with more bits where dimensions vary more (rotated first for -pca)."""

    trained = True
    bits: np.ndarray | None = None

    def __init__(self, dim, size, pca=False, weighted=False):
        super().__init__(dim)
        if not 1 <= size <= dim:
            raise VectorError(f"mixed: {size} bytes for {dim} dimensions")
        self.size, self.pca, self.weighted = size, pca, weighted
        self.name = f"mixed{size}{'-pca' * pca}{'-w' * weighted}"

    def ready(self):
        if self.bits is None:
            raise NotFitted(self.name)

    def fit(self, sample):
        x = self.check(sample)
        if not len(x):
            raise VectorError("nothing to fit on")
        self.rotation = np.eye(self.dim, dtype=np.float32)
        if self.pca:
            centred = x - x.mean(0)
            values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
            self.rotation = vectors[:, np.argsort(-values, kind="stable")].T.astype(np.float32)
            x = x @ self.rotation.T.astype(np.float64)
        return self.set_moments(x.mean(0), x.var(0))

    def fit_frame(self, df: DataFrame, vector_col: str, id_col: str) -> "Mixed":
        """Moments of the whole collection as aggregates; with a rotation, a fit on FIT_VECTORS vectors at most."""
        if self.pca:
            from vecloom.operators.retrieval import even_sample

            return self.fit(matrix(even_sample(df.select(id_col, vector_col), FIT_VECTORS, id_col).orderBy(id_col).toArrow().column(vector_col)))
        x = F.col("x").cast("double")
        rows = df.select(F.posexplode(vector_col).alias("i", "x")).groupBy("i").agg(F.avg(x).alias("mean"), F.var_pop(x).alias("variance")).orderBy("i").collect()
        if not rows:
            raise VectorError("nothing to fit on")
        if len(rows) != self.dim:
            raise VectorError(f"{self.name}: {len(rows)} dimensions where {self.dim} are due")
        return self.set_moments([r["mean"] for r in rows], [r["variance"] for r in rows])

    def set_moments(self, mean, variance):
        """Parameters from the mean and population variance of every (rotated) dimension."""
        mean, variance = np.asarray(mean, float), np.asarray(variance, float)
        if not self.pca:
            self.rotation = np.eye(self.dim, dtype=np.float32)
        worth = variance * (variance + mean * mean) if self.weighted else variance
        self.bits = allocate(worth, 8 * self.size)
        self.mean = mean.astype(np.float32)
        self.step = (np.append(0, STEPS)[self.bits] * np.sqrt(variance)).astype(np.float32)
        return self

    def params(self):
        self.ready()
        rotation = self.rotation.astype("<f4").tobytes() if self.pca else b""
        return bytes([self.pca]) + self.bits.astype(np.uint8).tobytes() + self.mean.astype("<f4").tobytes() + self.step.astype("<f4").tobytes() + rotation

    def restore(self, params):
        d = self.dim
        if len(params) != 1 + 9 * d + (4 * d * d if self.pca else 0) or params[0] != self.pca:
            raise VectorError(f"{self.name}: bad parameters")
        bits = np.frombuffer(params[1 : 1 + d], np.uint8).astype(np.int64)
        rest = np.frombuffer(params[1 + d :], "<f4")
        if bits.max() > 8 or bits.sum() > 8 * self.size or not np.isfinite(rest).all():
            raise VectorError(f"{self.name}: bad parameters")
        self.bits, self.mean, self.step = bits, rest[:d].copy(), rest[d : 2 * d].copy()
        self.rotation = rest[2 * d :].reshape(d, d).copy() if self.pca else np.eye(d, dtype=np.float32)
        return self

    def _turned(self, x):
        return x @ self.rotation.T.astype(np.float64) if self.pca else x

    def encode(self, x):
        """Codes a dimension (0 where it has no bits); pack() joins their bits."""
        self.ready()
        y = self._turned(self.check(x)) - self.mean.astype(np.float64)
        top = 2.0**self.bits - 1
        step = np.where(self.step == 0, 1, self.step).astype(np.float64)
        scaled = y / step + top / 2
        q = np.clip(np.sign(scaled) * np.floor(np.abs(scaled) + 0.5), 0, top)
        return np.where(self.step == 0, np.clip(np.floor(top / 2 + 0.5), 0, top), q).astype(np.uint8)

    def decode(self, codes):
        self.ready()
        y = self.mean.astype(np.float64) + np.where(self.bits > 0, (codes - (2.0**self.bits - 1) / 2) * self.step, 0)
        return y @ self.rotation.astype(np.float64) if self.pca else y

    def pack(self, codes):
        keep = np.arange(8)[None, :] < self.bits[:, None]
        planes = (codes[:, :, None] >> np.arange(8)) & 1
        out = np.zeros((len(codes), 8 * self.size), np.uint8)
        out[:, : keep.sum()] = planes[:, keep]
        return [row.tobytes() for row in _bits(out)]

    def unpack(self, blobs):
        bits = np.unpackbits(super().unpack(blobs), axis=1, bitorder="little")
        keep = np.arange(8)[None, :] < self.bits[:, None]
        planes = np.zeros((len(blobs), self.dim, 8), np.uint8)
        planes[:, keep] = bits[:, : keep.sum()]
        return (planes << np.arange(8, dtype=np.uint8)).sum(2).astype(np.uint8)

    def decode_col(self, code: Column) -> Column:
        if self.pca:
            raise VectorError("a rotated codec has no Column side")
        half, step, mean = ((2.0**self.bits - 1) / 2).tolist(), np.where(self.bits > 0, self.step, 0).astype(float).tolist(), self.mean.astype(float).tolist()
        return F.transform(code, lambda q, i: F.get(F.lit(mean), i) + (q - F.get(F.lit(half), i)) * F.get(F.lit(step), i))

    def encode_col(self, v: Column) -> Column:
        if self.pca:
            raise VectorError("a rotated codec has no Column side")
        top, step, mean = (2.0**self.bits - 1).tolist(), self.step.astype(float).tolist(), self.mean.astype(float).tolist()

        def one(x, i):
            t, s = F.get(F.lit(top), i), F.get(F.lit(step), i)
            scaled = F.when(s == 0, F.lit(0.0)).otherwise((x.cast("double") - F.get(F.lit(mean), i)) / F.nullif(s, F.lit(0.0))) + t / 2
            return F.greatest(F.lit(0.0), F.least(t, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5))).cast("smallint")

        return F.transform(v, one)


SIMPLE = {c.name: c for c in (F32, Int8, Binary, BinaryCentred, BinaryHamming)}


def codec_names() -> list[str]:
    return [*SIMPLE, "pq<m>", "mrl<k>[+<inner>]", "mixed<bytes>[-pca][-w]"]


def codec_by_name(name: str, dim: int) -> Codec:
    if name in SIMPLE:
        return SIMPLE[name](dim)
    if found := re.fullmatch(r"pq(\d*)", name):
        return PQ(dim, int(found[1]) if found[1] else max(dim // 8, 1))
    if found := re.fullmatch(r"mixed(\d*)(-pca)?(-w)?", name):
        return Mixed(dim, int(found[1]) if found[1] else max(dim // 8, 1), bool(found[2]), bool(found[3]))
    if found := re.fullmatch(r"mrl(\d+)(?:\+(.+))?", name):
        k = int(found[1])
        if not 1 <= k <= dim:
            raise VectorError(f"{name}: {k} of {dim} dimensions")
        return Truncated(dim, k, codec_by_name(found[2] or "f32", k), f"+{found[2]}" if found[2] else "")
    raise VectorError(f"unknown codec {name!r}: {', '.join(codec_names())}")


def codec_with_params(name: str, dim: int, params: bytes) -> Codec:
    return codec_by_name(name, dim).restore(params)


def fit_codec(name: str, collection: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> Codec:
    """A codec fitted on the whole collection, but for rotated mixed codecs (FIT_VECTORS vectors at most, evenly spread)."""
    codec = codec_by_name(name, dim)
    return codec.fit_frame(collection, vector_col, id_col) if codec.trained else codec
