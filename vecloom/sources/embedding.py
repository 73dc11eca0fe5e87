"""Embedders and chat models: a deterministic hash embedder, clients behind one interface, and their retry policy."""

from __future__ import annotations

import functools
import json
import random
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


#: Letters with their dependent signs, and digits.
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")


@functools.lru_cache(1 << 16)
def _hashed(word: str) -> int:
    return fnv1a(word.lower().encode())


def hash_embed(text: str, dim: int) -> np.ndarray:
    """Signed counts of hashed words (letters and digits, lower case), to unit length."""
    v = np.zeros(dim, np.float32)
    places = [_hashed(word) for word in _WORD.findall(text)]
    if places:
        h = np.array(places, np.uint64)
        np.add.at(v, (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), np.float32(-1), np.float32(1)))
    n = np.sqrt((v * v).sum(dtype=np.float32))
    return v / n if n else v


def embed_frame(df: DataFrame, id_col: str, text_col: str, embed) -> DataFrame:
    """(id, vector) through embed(list of texts) -> list of vectors, a batch at a time on the executors."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(v, np.float32) for v in embed(texts)], pa.list_(pa.float32()))], names=["id", "vector"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, "id long, vector array<float>")


def prefixed(text: Column, prefix: str) -> Column:
    """What a model that tells queries from passages is sent; an empty prefix leaves the text as it is."""
    return F.concat(F.lit(prefix), text) if prefix else text


def hash_embeddings(df: DataFrame, id_col: str, text_col: str, dim: int, prefix: str = "") -> DataFrame:
    return embed_frame(df, id_col, text_col, lambda texts: [hash_embed(prefix + t, dim) for t in texts])


@dataclass
class Attempt:
    number: int
    status: int | None
    outcome: str
    elapsed_ms: int
    backoff_ms: int


RETRIED = {408, 409, 429}


def backoff_ms(attempt: int, retry_after: float | None, rng=random) -> int:
    """What the server asks for, if a minute at most, else 2^(n-1) seconds up to 30 and up to 250 ms more."""
    if retry_after is not None and 0 <= retry_after <= 60:
        return int(retry_after * 1000)
    return min(1000 * 2 ** (attempt - 1), 30_000) + rng.randrange(250)


def with_retries(call, attempts: int = 3, sleep=time.sleep) -> tuple[object, list[Attempt]]:
    """call() -> (status or None, retry_after or None, result); transport errors and some statuses are tried again."""
    log: list[Attempt] = []
    for n in range(1, attempts + 1):
        began = time.perf_counter()
        try:
            status, after, result = call()
        except OSError as e:
            status, after, result = None, None, e
        took = int(1000 * (time.perf_counter() - began))
        again = status is None or status in RETRIED or status >= 500
        if not again or n == attempts:
            log.append(Attempt(n, status, "ok" if status is not None and status < 400 else "failed", took, 0))
            return result, log
        wait = backoff_ms(n, after)
        log.append(Attempt(n, status, "retried", took, wait))
        sleep(wait / 1000)
    raise AssertionError


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 60):
    """(status, retry_after, decoded body), as with_retries wants it."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, None, json.loads(r.read())
    except urllib.error.HTTPError as e:
        after = e.headers.get("retry-after")
        return e.code, float(after) if after and after.replace(".", "", 1).isdigit() else None, e


@dataclass
class RemoteEmbedder:
    """An embeddings endpoint; answers are put in the order of their index and counted."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        status, _, body = post_json(f"{self.url.rstrip('/')}/embeddings", {"model": self.model, "input": texts}, self.headers)
        if status != 200:
            raise OSError(f"embedding failed with {status}")
        rows = sorted(body["data"], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise OSError(f"{len(rows)} embeddings for {len(texts)} texts")
        return [r["embedding"] for r in rows]


class MockChat:
    """A chat model that answers with the first passage's first sentence: the default, as nothing here needs a network."""

    name = "mock"

    def complete(self, system: str, user: str) -> dict:
        found = re.search(r"^\[1\][^\n]*\n(.+?)(?:[.!?]\s|\n)", user, re.M | re.S)
        text = found[1] if found else "The passages do not contain the answer."
        return {"text": text, "model": self.name, "input_tokens": len(user.split()), "output_tokens": len(text.split())}


@dataclass
class RemoteChat:
    """A chat completions endpoint."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)

    def complete(self, system: str, user: str) -> dict:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        result, log = with_retries(lambda: post_json(f"{self.url.rstrip('/')}/chat/completions", body, self.headers))
        if isinstance(result, Exception):
            raise result
        usage = result.get("usage", {})
        return {"text": result["choices"][0]["message"]["content"], "model": result.get("model", self.model), "input_tokens": usage.get("prompt_tokens", 0), "output_tokens": usage.get("completion_tokens", 0), "attempts": log}


def parse_payload(name: str) -> tuple[str, int | str | None]:
    """none, truncate:N (N > 0) or http:<url>."""
    if name == "none":
        return "none", None
    if (found := re.fullmatch(r"truncate:(\d+)", name)) and int(found[1]) > 0:
        return "truncate", int(found[1])
    if name.startswith("http:") and len(name) > 5:
        return "http", name[5:]
    raise ValueError(f"payload {name!r}: none, truncate:N or http:<url>")


def apply_payload(passages: DataFrame, name: str, question: str, text_col: str = "text") -> DataFrame:
    """Passages after a payload step: as many and in the same order."""
    kind, arg = parse_payload(name)
    if kind == "none":
        return passages
    if kind == "truncate":
        from vecloom.functions.text import truncate_words

        return passages.withColumn(text_col, truncate_words(F.col(text_col), arg))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            status, _, body = post_json(arg, {"question": question, "passages": batch.column(at).to_pylist()})
            if status != 200 or len(body["passages"]) != batch.num_rows:
                raise OSError(f"payload step failed with {status}")
            yield batch.set_column(at, text_col, pa.array(body["passages"], pa.string()))

    return passages.mapInArrow(run, passages.schema)
