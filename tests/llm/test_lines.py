import random

import pytest

from vecloom.llm import lines


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def edited(rng, text, n, alphabet):
    s = list(text)
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice(alphabet)
        kind = rng.randrange(3)
        if kind == 0 or not s:
            s.insert(i, c)
        elif kind == 1:
            s.pop(min(i, len(s) - 1))
        else:
            s[min(i, len(s) - 1)] = c
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3, 4])
def test_edit_distance(spark, tau):
    rng = random.Random(tau)
    rows = []
    for k in range(1500):
        a = "".join(rng.choice("ab😀é") for _ in range(rng.randrange(0, 14)))
        rows.append((k, k, a, edited(rng, a, rng.randrange(6), "ab😀c")))
    df = spark.createDataFrame(rows, "u long, v long, a string, b string")
    assert {r.u for r in lines.close_pairs(df, tau).collect()} == {u for u, _, a, b in rows if lev(a, b) <= tau}


def docs_of(seed, tau, per):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é😀") for _ in range(rng.choice([3, per - 2, per, per + 1, 2 * per - 1, 2 * per, 2 * per + 1, 40, 90]))) for _ in range(40)]
    rows = [(5, None), (6, ""), (7, "\n \n\t"), (None, pool[0] + "\n" + pool[1]), (None, "only here, under no id at all\nonly here, under no id at all"), (8, pool[2] + "\n" + pool[2]), (8, pool[2] + "\n" + pool[2]), (9, "z" * 30000), (10, "z" * 30001 + "\r")]
    for k in range(20, 70):
        rows.append((k, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3, 4]), "abx") for _ in range(rng.randrange(1, 6)))))
    rng.shuffle(rows)
    return rows


def brute(rows, tau, per):
    texts = sorted({x for _, t in rows for x in (t or "").split("\n") if t and x.strip(" ")})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {x: 0 for x in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            t = min(tau, min(len(a), len(b)) // per)
            if t and abs(len(a) - len(b)) <= t and (len(a) < 1000 and lev(a, b) <= t or len(a) > 1000 and a[:29000] == b[:29000]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first, seen = {}, []
    for i, t in rows:
        for n, x in enumerate(t.split("\n") if t is not None else []):
            c = find(x) if x.strip(" ") else None
            seen.append((i, n, c, links.get(x)))
            if c is not None and i is not None:
                first[c] = min(first.get(c, (i, n)), (i, n))
    return [(i, n, c, k, c in first and first[c] != (i, n)) for i, n, c, k in seen]


@pytest.mark.parametrize("tau, clashing", [(1, False), (2, False), (2, True)])
def test_matches_all_pairs(spark, monkeypatch, tau, clashing):
    if clashing:
        monkeypatch.setattr(lines, "_ID", "(xxhash64(line) & 30L)")
    rows = docs_of(tau, tau, 12)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, line_no int, key string").repartition(4)
    got = [tuple(r) for r in lines.line_classes(df, tau=tau, per=12).drop("row_key").collect()]
    want = brute(rows, tau, 12)
    key = lambda r: (str(r[0]), r[1], r[3] is None, r[3] or 0, r[4])
    got.sort(key=key), want.sort(key=key)
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(r[0], r[1], r[3], r[4]) for r in want]
    # The same partition into classes, whatever their names.
    same = lambda rs: sorted(sorted(str((r[0], r[1])) for r in rs if r[2] == c) for c in {r[2] for r in rs})
    assert same(got) == same(want)


def test_texts_without_repeats(spark):
    long = "this line is long enough to be compared"
    df = spark.createDataFrame([(2, f"{long}!\nshort\n\nown"), (1, f"{long}\nshort"), (3, long), (4, None)], "doc_id long, text string").withColumn("n_chars", lines.F.length("text").cast("long"))
    out = {r.doc_id: (r.text, r.n_chars) for r in lines.without_repeats(df).collect()}
    assert out == {1: (f"{long}\nshort", len(long) + 6), 2: ("\nown", 4), 3: ("", 0), 4: (None, None)}


def test_clashing_columns_and_many_repeated_lines(spark):
    names = ["_id", "_key", "_gone", "id", "hash", "row", "numbers", "kept", "row_key", "line_no", "class_id", "a.b"]
    text = "\n".join(f"line {k} of a text with very many lines" for k in range(6000))
    df = spark.createDataFrame([(k, text, *names) for k in (1, 2)], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    out = {r["doc_id"]: r for r in lines.without_repeats(df).collect()}
    assert all(list(r)[2:] == names for r in out.values()) and out[2]["text"] == "" and out[1]["text"]


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a line that is long enough to be compared")], "doc_id long, text string")
    plan = lines.line_classes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert lines.line_classes(df.limit(0)).collect() == []


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_probes_meet_the_segments_of_close_lines(spark, tau):
    """And are made of plain columns in generated code: functions of array elements are interpreted, row after row."""
    rng = random.Random(tau)
    rows = []
    for k in range(300):
        long = "".join(rng.choice("ab😀é" if k % 2 else "abcd") for _ in range(rng.randrange(12 * tau, 14 * tau + 30)))
        rows.append((k, long, edited(rng, long, rng.randrange(tau + 1), "abcé")))
    rows = [(k, *sorted((a, b), key=len)) for k, a, b in rows if len(a) >= 12 and len(b) >= 12]
    df = spark.createDataFrame(rows, "k long, short string, long string")
    own = "case " + " ".join(f"when {lines._permitting(t, tau, 12, 'n')} then array({', '.join(lines._own(t))})" for t in range(1, tau + 1)) + " end"
    short = df.selectExpr("k", "short as line", "length(short) as n").selectExpr("k", "n", f"explode({own}) as key")
    probes = lines.probed(df.selectExpr("k * 2 as id", "length(long) as n", "long as line", "0L as sign"), tau, 12)
    met = short.join(probes.selectExpr("shiftright(code, 1) as k", "key"), ["k", "key"]).select("k").distinct()
    want = {k for k, a, b in rows if lev(a, b) <= min(tau, len(a) // 12)}
    assert want and want <= {r.k for r in met.collect()}
    plan = probes._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "*(1) Generate" in plan
