import pytest

from vecloom.llm import warc

ROWS = [
    (1, "http://a/1", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, None, "<p>same</p>"),
    (4, "http://b/ü%0A\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (5, "x", None), (6, "y", ""), (8, "z", "é" * 70000),
    (None, "n", "<p>same</p>"), (None, "m", "alone"), (9, "twice", "dup"), (9, "twice", "dup"), (2, "w", "dup"),
]


def want(rows):
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", float("-inf")), float("-inf") if i is None else i)
    out = []
    for i, _, t in rows:
        top = best[t or ""]
        kind = "response" if top == (float("-inf") if i is None else i) else "revisit"
        raw = (t or "").encode()
        out.append((i, len(raw), warc.digest(raw), kind, top if kind == "revisit" else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload_digest string")
    assert got(warc.dedup_archive(df)) == want(ROWS)


def test_urls_and_bodies_survive_and_an_archive_can_be_deduplicated_again(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(warc.with_digests(df, "page_id", "url", "html").withColumns({"record_type": warc.F.lit("response"), "refers_to": warc.F.lit(None).cast("long")}), f"file://{tmp_path}/raw")
    records = warc.read_archives(spark, f"file://{tmp_path}/raw")
    assert sorted(((r.page_id, r.url, r.body) for r in records.collect()), key=str) == sorted(((i, u, t or "") for i, u, t in ROWS), key=str)
    for source, target in (("raw", "once"), ("once", "again")):
        warc.rededup_archive(spark, f"file://{tmp_path}/{source}", f"file://{tmp_path}/{target}")
        assert got(warc.expand_revisits(warc.read_archives(spark, f"file://{tmp_path}/{target}"))) == want(ROWS)


def test_min_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "v", "aa")], "page_id long, url string, html string")
    assert [r.record_type for r in warc.dedup_archive(df, min_bytes=3).collect()] == ["response"] * 2
    assert warc.dedup_archive(df.limit(0)).collect() == []


def test_long_payloads_and_many_copies_in_several_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    texts = {0: "a\n" * 300_000, 1: "é" * 2_000_000, 2: "\n\n\r\n", 3: None}
    many = [(i, f"u{i}", texts.get(i % 9, "shared")) for i in range(60)]
    df = spark.createDataFrame([(*r, 0, 0) for r in many], "page_id long, url string, html string, first_id int, digest int")
    assert got(warc.dedup_archive(df)) == want(many)


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"]))
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabcd\r\n\r\n"]))
