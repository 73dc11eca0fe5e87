import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.sources import catalog, embedding, formats
from vecloom.streaming import memory as stream


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_question_sets(spark, tmp_path):
    good = put(tmp_path / "q.jsonl", '# head\n\n{"id": "a", "question": "Q?", "answers": ["x"], "relevant": ["d1"]}\n{"id": "b", "question": "R?", "query": "r"}\n')
    q = formats.read_questions(spark, good)
    assert {r.id: (r.answers, r.relevant, r.t) for r in q.select("*", formats.retrieval_text().alias("t")).collect()} == {"a": (["x"], ["d1"], "Q?"), "b": ([], [], "r")}
    formats.write_questions(q, f"file://{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ['{"id":"a","question":"Q?","answers":["x"],"relevant":["d1"]}', '{"id":"b","question":"R?","query":"r"}']
    assert catalog.describe_questions(q).first().asDict() == {"questions": 2, "with_answers": 1, "with_query": 1, "with_source": 0, "judged": 1, "judgments": 1}
    for bad in ("{not json\n", '{"id": "a", "question": "x"}\n{"id": "a", "question": "y"}\n', "# nothing\n"):
        with pytest.raises(formats.FormatError):
            formats.read_questions(spark, put(tmp_path / "bad.jsonl", bad))
    with pytest.raises(formats.FormatError):
        formats.read_memory_script(spark, put(tmp_path / "m.jsonl", '{"id": "1", "write": "a", "ask": "b"}\n'))
    assert formats.read_memory_script(spark, put(tmp_path / "m2.jsonl", '{"id": "1", "write": "a"}\n{"id": "2", "ask": "b"}\n')).count() == 2


def test_benchmark_files(spark, tmp_path):
    qrels = formats.read_qrels(spark, put(tmp_path / "test.tsv", "query-id\tcorpus-id\tscore\nq1\td2\t1\nq1\td1\t2\nq1\td1\t1\nq2\td3\t0\n"))
    assert [tuple(r) for r in qrels.collect()] == [("q1", ["d1", "d2"])]
    queries = formats.read_corpus(spark, put(tmp_path / "queries.jsonl", '{"_id": "q1", "text": "a  b"}\n{"_id": "q2", "text": "c"}\n'))
    assert formats.beir_questions(queries, qrels).first().question == "a b"
    claims = formats.read_claims(spark, put(tmp_path / "claims.jsonl", '{"id": 1, "claim": "c", "evidence": {"9": [{"label": "SUPPORT"}], "8": [{"label": "SUPPORT"}]}}\n{"id": 2, "claim": "d", "evidence": {"9": [{"label": "SUPPORT"}, {"label": "CONTRADICT"}]}}\n{"id": 3, "claim": "e", "evidence": {}}\n'))
    assert {r.id: r.label for r in claims.collect()} == {"1": "SUPPORT", "2": None, "3": None}
    assert [r.query for r in formats.read_query_lines(spark, put(tmp_path / "lines.txt", " one \n\n two\n")).collect()] == ["one", "two"]
    corpus = formats.read_corpus(spark, put(tmp_path / "corpus.jsonl", '{"_id": "d1", "title": "T", "text": " x "}\n{"_id": "d2", "text": "y"}\n'))
    assert sorted(r.b for r in corpus.select(formats.corpus_body(F.col("title"), F.col("text")).alias("b")).collect()) == ["T\n\nx\n", "y\n"]
    formats.write_corpus(corpus, f"file://{tmp_path}/docs")
    assert spark.read.text(f"file://{tmp_path}/docs").where("id = 'd1'").count() == 3
    formats.coir_to_beir(corpus, queries, spark.createDataFrame([("q1", "d1", 1)], "`query-id` string, `corpus-id` string, score int"), f"file://{tmp_path}/beir")
    assert formats.read_qrels(spark, f"file://{tmp_path}/beir/qrels").first().relevant == ["d1"]


def test_documents_and_code_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/x.md", "a/b/y.MD", "a/z.bin"):
        (tmp_path / name).write_text(name + " text")
    found = formats.read_documents(spark, [f"file://{tmp_path}/a"], ["md", ".txt"])
    assert [r.source.rsplit("/", 1)[1] for r in found.collect()] == ["y.MD", "x.md"]
    ids, codes = np.array([3, 5, 9]), [b"ab", b"cd", b"ef"]
    raw = formats.code_file(ids, codes)
    back = formats.parse_code_file(raw)
    assert back[0].tolist() == [3, 5, 9] and back[1] == codes
    (tmp_path / "c.bin").write_bytes(raw)
    assert [(r.id, bytes(r.code)) for r in formats.read_code_files(spark, f"file://{tmp_path}/c.bin").collect()] == [(3, b"ab"), (5, b"cd"), (9, b"ef")]
    for bad in (b"x", raw[:-1], b"WRONGMAG" + raw[8:]):
        with pytest.raises(formats.FormatError):
            formats.parse_code_file(bad)


def test_text_edges(spark):
    df = spark.createDataFrame([("1 2 3 4 5 6 7 8 9 10",), ("",), ("one",)], "t string")
    assert [r[0] for r in df.select(T.chunks(df.t, 4, 1)).collect()] == [["1 2 3 4", "4 5 6 7", "7 8 9 10"], [], ["one"]]
    assert [len(r[0]) for r in df.select(T.chunks(df.t, 3, 9)).collect()] == [8, 0, 1]
    long = "Cats purr a lot. Dogs bark loudly! Birds sing songs? Nothing else."
    row = spark.createDataFrame([(long, "Do dogs or birds sing?"), (long, "zzz"), ("", "q")], "t string, q string")
    out = [r[0] for r in row.select(T.compress_extractive(F.col("t"), F.col("q"), 5)).collect()]
    assert out == ["Birds sing songs?", "Cats purr a lot.", ""]


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/store")
    c.create("a", "p", "m", 2, "f32", "cosine", "2024")
    with pytest.raises(catalog.CatalogError):
        c.create("a", "p", "m", 2, "f32", "cosine", "2024")
    c.ensure("b", "p", "m", 2, "int8", "cosine", "2024")
    with pytest.raises(catalog.CatalogError):
        c.ensure("b", "p", "other", 2, "int8", "cosine", "2024")
    rows = spark.createDataFrame([(f"s{i % 3}", i, f"t{i}", bytearray(b"12345678")) for i in range(10)], "source string, ordinal int, text string, vector binary")
    c.insert_chunks("a", rows)
    first = c.codes("a")
    assert first.count() == 10 and c.codes("a") is first
    c.insert_chunks("a", rows)
    assert sorted(r.id for r in c.codes("a").collect()) == list(range(1, 21))
    assert {r.name: r.chunk_count for r in c.collections().collect()} == {"a": 20, "b": 0}
    c.delete("a")
    assert {r.name: r.chunk_count for r in c.collections().collect()} == {"b": 0}
    with pytest.raises(catalog.CatalogError):
        c.require("a")
    c.ensure_session("s", "2024")
    c.ensure_session("s", "2025")
    for role in ("user", "tool", "assistant"):
        c.append_message("s", role, role, "2024")
    assert [r.role for r in c.messages("s").collect()] == ["user", "assistant"] and c.sessions().first().message_count == 3
    c.delete_session("s")
    assert c.sessions().count() == c.table("messages").count() == 0


def test_embedding_and_retries(spark):
    assert embedding.fnv1a(b"") == 0xCBF29CE484222325 and embedding.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    v = embedding.hash_embed("Hello, hello WORLD", 128)
    assert np.isclose(np.linalg.norm(v), 1) and np.array_equal(v, embedding.hash_embed("world hello-HELLO", 128)) and not embedding.hash_embed("?!", 8).any()
    replies = iter([(503, None, "x"), (429, 2.0, "x"), (200, None, "done")])
    waits = []
    result, log = embedding.with_retries(lambda: next(replies), sleep=waits.append)
    assert result == "done" and [a.outcome for a in log] == ["retried", "retried", "ok"] and 1 <= waits[0] < 1.25 and waits[1] == 2
    assert embedding.with_retries(lambda: (400, None, "no"), sleep=waits.append)[1][0].outcome == "failed" and len(waits) == 2
    assert embedding.parse_payload("truncate:3") == ("truncate", 3)
    for bad in ("truncate:0", "zip", "http:"):
        with pytest.raises(ValueError):
            embedding.parse_payload(bad)
    df = spark.createDataFrame([("a b c d",)], "text string")
    assert embedding.apply_payload(df, "truncate:2", "q").first().text == "a b"
    assert embedding.MockChat().complete("s", "Context passages:\n\n[1] (source: x, chunk 0)\nIt is so. More\n\nQuestion: q")["text"] == "It is so"


def test_stream_equals_batch(spark):
    from vecloom.session import sample_dir, table

    d = sample_dir("sf0.001")
    rows = stream.prepared(table(spark, d, "conversations"))
    want = stream.answers(rows.where("step = 'ask'"), rows.where("step = 'write'"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(stream.replay_conversations(spark, d)) == key(want)
    assert stream.windowed_counts(table(spark, d, "events")).count() > 0
