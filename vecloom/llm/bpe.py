"""Byte-pair token counts (heap and linked list) and encoding/decoding (forced-boundary splitting).

Both read a vocabulary file of the tokenizers library; its normaliser and
pre-tokeniser cut a text into words, and the merging is done here. Special
strings inside a text become their own ids, as that library does by default.

Defined results: a null text counts as empty (no tokens); rows are handled one
by one, so repeated rows, null ids and ties give the same answer each time; an
empty table gives an empty table; columns other than the named ones are unread.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm.store import tidied

VOCABULARY = "word_bpe_49k.json"
#: Words remembered by a worker.
CACHE_WORDS = 400_000


#: Ranges in which the library's character classes and those of the regex module agree (a test holds them against each
#: other); a text with other characters is cut by the library itself.
_OTHER = re.compile("[^\\x00-\u053f\u3000-\u9fff\uac00-\ud7a3]")
_BYTES = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)}
_BYTES |= {b: chr(256 + k) for k, b in enumerate(b for b, c in list(_BYTES.items()) if not c)}


class _Cache(dict):
    """Remembers make(key) for the keys met lately: when full, it becomes the older half and a new one begins."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def forget(self) -> None:
        """A worker outlives its task; what it has learned need not."""
        self.clear()
        self.older = {}

    def __missing__(self, key):
        if len(self) >= CACHE_WORDS // 2:
            self.older = self.copy()
            self.clear()
        value = self.older.get(key)
        value = self[key] = self.make(key) if value is None else value
        return value


class Vocabulary:
    """A byte-level vocabulary with word ends, its merge ranks and its boundary pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {pair: r for r, pair in reversed(list(enumerate(pairs)))}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self._special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        library = Tokenizer.from_file(path)
        self._normal, self._cut = library.normalizer, library.pre_tokenizer
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._find = regex.compile(pattern).findall
        #: Adjacent symbols found inside some token; any other adjacent pair can never be merged across.
        self.inside: set[tuple[str, str]] = set()
        for token in self.ids:
            parts = self.symbols(token[: -len(self.suffix)]) if self.suffix and token.endswith(self.suffix) else list(token)
            self.inside.update(zip(parts, parts[1:]))
        self.counts = _Cache(lambda word: self.count_word(self.byte_chars(word)))
        self.codes = _Cache(self._code)

    @staticmethod
    def byte_chars(word: str) -> str:
        """A word's UTF-8 bytes in the characters that stand for them in the vocabulary."""
        return "".join(map(_BYTES.__getitem__, word.encode()))

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix] if word else []

    def pieces(self, text: str):
        """(special id, None) or (None, words) in order."""
        at = 0
        for found in self._special_re.finditer(text) if self._special_re else ():
            yield None, self._words(text[at : found.start()])
            yield self.special[found[0]], None
            at = found.end()
        yield None, self._words(text[at:] if at else text)

    def _words(self, text: str) -> list[str]:
        text = text.lower() if text.isascii() else self._normal.normalize_str(text) if text else ""
        if not _OTHER.search(text):
            return self._find(text)
        return [text[a:b] for _, (a, b) in self._cut.pre_tokenize_str(text)]

    def count_word(self, word: str) -> int:
        """Tokens of one word: its symbols less the merges made, lowest rank first, leftmost on ties."""
        part = self.symbols(word)
        n = len(part)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank, heap = self.rank, []
        for i in range(n - 1):
            r = rank.get((part[i], part[i + 1]))
            if r is not None:
                heap.append((r, i, part[i], part[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue  # stale
            part[i], part[j] = left + right, ""
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return n - merges

    def count(self, text: str) -> int:
        get = self.counts.__getitem__
        return sum(1 if special is not None else sum(map(get, words)) for special, words in self.pieces(text))

    def fragments(self, word: str) -> list[list[str]]:
        """A word's symbols, cut between every two that no token holds side by side."""
        part = self.symbols(word)
        out = [part[:1]]
        for x in zip(part, part[1:]):
            if x in self.inside:
                out[-1].append(x[1])
            else:
                out.append([x[1]])
        return out

    def merge(self, part: list[str]) -> list[str]:
        """One fragment's tokens: the lowest-ranked pair is merged, leftmost first, until none is left."""
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(x, none) for x in zip(part, part[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            part[i] += part.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((part[i - 1], part[i]), none)
            if i < len(ranks):
                ranks[i] = rank((part[i], part[i + 1]), none)
        return part

    def encode_word(self, word: str) -> list[int]:
        # A long fragment would make the scans above quadratic.
        return [self.ids[t] for f in self.fragments(word) for t in (self.merge(f) if len(f) <= 500 else self._merge_long(f))]

    def _merge_long(self, part: list[str]) -> list[str]:
        n, rank = len(part), self.rank
        part, after, before = list(part), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[x], i, *x) for i, x in enumerate(zip(part, part[1:])) if x in rank]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue
            part[i], part[j] = left + right, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (part[i], part[k]) in rank:
                    heapq.heappush(heap, (rank[part[i], part[k]], i, part[i], part[k]))
            if (h := before[i]) >= 0 and (part[h], part[i]) in rank:
                heapq.heappush(heap, (rank[part[h], part[i]], h, part[h], part[i]))
        return [p for p in part if p]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' names joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))

    def _code(self, word: str) -> tuple[int, str, str]:
        ids = self.encode_word(self.byte_chars(word))
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids in decimal joined by one space, and the decoded text."""
        get, found = self.codes.__getitem__, []
        for special, words in self.pieces(text):
            if special is not None:
                found.append((1, str(special), self.names[special]))
            else:
                found.extend(map(get, words))
        if not found:
            return 0, "", ""
        n, ids, names = zip(*found)
        return sum(n), " ".join(ids), " ".join(names)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def _texts(batch: pa.RecordBatch):
    """Texts of a batch one at a time, in its slices, so that long ones are not all alive at once."""
    for x in batch.column(1):
        yield x.as_py() or ""


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_name: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and over_limit. No shuffle: one pass over the scan."""

    def run(batches):
        words = vocabulary(vocabulary_path(vocabulary_name))
        words.counts.forget()
        for batch in batches:
            n = [words.count(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])
        words.counts.forget()

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidied(run), f"{id_col} long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_name: str = VOCABULARY) -> DataFrame:
    """Per row: id, n_tokens, ids_text (decimal ids joined by a space) and decoded. One pass, no shuffle."""

    def run(batches):
        words = vocabulary(vocabulary_path(vocabulary_name))
        words.codes.forget()
        for batch in batches:
            ids = batch.column(0)
            at, size, rows = 0, 0, []
            for k, text in enumerate(_texts(batch)):
                rows.append(words.encode(text))
                size += len(text)
                if size > 2 << 20 or k == batch.num_rows - 1:
                    n, codes, names = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids[at : k + 1], pa.array(n, pa.int64()), pa.array(codes, pa.string()), pa.array(names, pa.string())], names=[id_col, "n_tokens", "ids_text", "decoded"])
                    at, size, rows = k + 1, 0, []
        words.codes.forget()

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), f"{id_col} long, n_tokens long, ids_text string, decoded string")
