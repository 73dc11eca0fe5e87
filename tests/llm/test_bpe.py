import hashlib

import pytest
from tokenizers import Tokenizer

from vecloom.llm import bpe

TEXTS = [None, "", " ", "Hello, World!  don't I'll 42 1234", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "naïve café İstanbul ß ẞ é", "漢字かな交じり文 😀😀👩‍👩‍👧", "x" * 5000, "ab" * 3000 + "!!!???" * 900, "tab\tnew\nline\x0b\x0c\r  end", "Ered*** reed&&& ndsh%%%", "<|ENDOFTEXT|>", "\u0000\u0001"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "y"), (1, "twice", "z"), (1, "twice", "z")], "doc_id long, text string, n_tokens string")


def test_counts_and_codes_match_the_library(spark, library, tmp_path):
    texts = TEXTS + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = frame(spark, texts)
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = ids
    for r in bpe.token_counts(df).where("doc_id is not null").collect():
        if r.n_bytes != 5 or r.doc_id != 1:
            assert r.n_tokens == len(want[r.doc_id]), texts[r.doc_id]
            assert r.over_limit == (r.n_tokens > 2048)
            assert r.n_bytes == len((texts[r.doc_id] or "").encode())
    for r in bpe.encode_decode(df).where("doc_id is not null").collect():
        if r.ids_text != " ".join(map(str, library.encode("twice").ids)):
            assert r.ids_text == " ".join(map(str, want[r.doc_id])), texts[r.doc_id]
            assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    assert bpe.token_counts(df).count() == bpe.encode_decode(df).count() == len(texts) + 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.token_counts(df).collect() == [] and bpe.encode_decode(df).collect() == []


def test_heap_equals_fragments():
    words = bpe.vocabulary(bpe.vocabulary_path())
    for w in ["internationalization", "aaaaaaaaaaaaaaa", "Ã©tÃ©", "zxqjk", "a"]:
        ids = words.encode_word(w)
        assert words.count_word(w) == len(ids) and [words.ids[t] for f in words.fragments(w) for t in words._merge_long(f)] == ids
    long = "ab" * 3000 + "Ã©" * 700
    assert words.count_word(long) == len(words.encode_word(long))


def test_queries(spark):
    from vecloom.llm import registry

    out = registry.op9_bpe(spark, "/root/testdata/sf0.001").limit(3).collect()
    assert len(out[0].ids_sha256) == 64 and hashlib.sha256(b"").hexdigest() != out[0].ids_sha256


def test_character_classes_agree_where_the_fast_path_is_taken(library):
    words = bpe.vocabulary(bpe.vocabulary_path())
    for c in [*range(0x540), *range(0x3000, 0xA000), *range(0xAC00, 0xD7A4)]:
        text = words._normal.normalize_str(f"a{chr(c)}! {chr(c)}{chr(c)}b'{chr(c)} 1{chr(c)}")
        if not bpe._OTHER.search(text):
            assert words._find(text) == [text[a:b] for _, (a, b) in words._cut.pre_tokenize_str(text)], hex(c)
    for c in range(128):
        assert chr(c).lower() == words._normal.normalize_str(chr(c)) or chr(c).isspace()


def test_random_unicode_matches_the_library(library):
    import random

    words, rng = bpe.vocabulary(bpe.vocabulary_path()), random.Random(3)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x370, 0x540), range(0x540, 0x2000), range(0x2000, 0x3100), range(0x1F300, 0x1FA00), range(0x300, 0x370), [9, 10, 13, 32, 0x85, 0xA0, 0x3000]]
    for _ in range(1500):
        text = "".join(chr(rng.choice(rng.choice(pools[: rng.randrange(1, 9)]))) for _ in range(rng.randrange(60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert words.encode(text)[1] == " ".join(map(str, ids)), ascii(text)
        assert words.count(text) == len(ids)
