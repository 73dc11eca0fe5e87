"""Line dedup by a segment-partition edit join, in DataFrame and SQL operations only.

Lines close to each other belong to one class, with all that they link. Close
are two lines if they are at most t edits (of characters) apart, t being one for
every EDIT_CHARS characters of the shorter, THRESHOLD at most (so lines of fewer
than EDIT_CHARS characters are close to equal ones only). A line that permits t
edits is cut into t + 1 near equal segments; if two lines are that close, one segment of the shorter occurs in the
longer near its place. Segments are indexed under their length and number, the
longer line probes the few starts that can match (multi-match-aware selection),
and the pairs found are verified by a banded bit-parallel edit distance: one
integer holds, for every number of errors, the diagonals of the band that are
still reachable, and one shift, mask and match a character moves it on. Before
that, the common beginning and end of a pair are set aside. Lines with a segment
that another line of their length shares also carry 64 parities of their pairs
of neighbouring characters: an edit changes four at most, so pairs that differ
in more than four a permitted edit are dropped where they meet.

Scale: lines are counted once, combined before the shuffle, so one that a third
of all rows share travels once a task; only distinct lines are indexed. Texts
are fetched for lines in a pair only, through a bit table of fixed size.

Defined results: lines are split at line feeds; blank ones and those of null
texts are in no class (null class_id) and stay. Of a class, the occurrence with
the smallest (doc_id, line_no) stays; repeated rows of a document keep the same
lines; lines of rows with a null doc_id go if the class occurs under some id,
else stay. Lines are equal if their texts are: a hash that different lines share
names none of them, a second one does. class_id is the smallest of the hashes
that name the class's lines. An empty table gives no rows; lines of any length
are read whole; other columns, whatever their names, come back unchanged from
without_repeats().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.graph import components
from vecloom.llm.store import narrowed, written

THRESHOLD = 2
EDIT_CHARS = 12
#: The bit table has this many words of 64 bits.
BIT_WORDS = 1 << 16


def _segment(i: int, length: str, tau: int) -> tuple[str, str]:
    """Start (from 1) and length of the i-th of tau + 1 segments; the last ones are longer by one where it doesn't divide."""
    parts = tau + 1
    base, longer = f"({length} div {parts})", f"({length} % {parts})"
    start = f"(1 + {i - 1} * {base} + greatest(0, {i - 1 - parts} + {longer}))"
    return start, f"({base} + if({i} > {parts} - {longer}, 1, 0))"


def _own(tau: int) -> list[str]:
    """SQL for the hashed segments of a line."""
    parts = [(i, *_segment(i, "n", tau)) for i in range(1, tau + 2)]
    return [f"xxhash64(n, {i}, substring(line, {start}, {size}))" for i, start, size in parts]


def _probes(tau: int, shift: int) -> list[tuple[int, int, int, int]]:
    """What a line probes as one shorter by shift, which permits tau edits: (shift, number of the segment, of how many,
    characters from its place)."""
    found = []
    for i in range(1, tau + 2):
        low, high = max(1 - i, shift - (tau + 1 - i)), min(i - 1, shift + (tau + 1 - i))
        found += [(shift, i, tau + 1, off) for off in range(low, high + 1)]
    return found


def _probes_of(tau: int, per: int) -> str:
    """SQL: all that a line of n characters probes, as one array of constants for each range of n."""

    def permits(n: int) -> int:
        return min(tau, n // per)

    edges = sorted({per * t + shift for t in range(1, tau + 1) for shift in range(t + 1)})
    cases = []
    for n in reversed(edges):
        found = [p for shift in range(tau + 1) if permits(n - shift) >= max(shift, 1) for p in _probes(permits(n - shift), shift)]
        rows = ", ".join(f"named_struct('shift', {a}, 'i', {i}, 'parts', {parts}, 'off', {off})" for a, i, parts, off in found)
        cases.append(f"when n >= {n} then array({rows})")
    return f"case {' '.join(cases)} end"


def probed(lines: DataFrame, tau: int, per: int) -> DataFrame:
    """lines(id, n, line, sign), one row for each segment probed: key, code (the id, its lowest bit set where the lines
    sought are of the same length), sign. Plain columns only: functions of array elements would be interpreted."""
    # Of a line of single bytes pieces are taken at once, of others by walking over the characters before them.
    raw = F.expr("if(octet_length(line) = n, cast(line as binary), null)").alias("raw")
    rows = lines.select("id", "n", "line", "sign", raw).select("id", "n", "line", "sign", "raw", F.inline(F.expr(_probes_of(tau, per))))
    rows = rows.withColumn("length", F.expr("n - shift")).withColumn("base", F.expr("cast(length div parts as int)")).withColumn("longer", F.expr("length % parts"))
    rows = rows.withColumn("at", F.expr("1 + (i - 1) * base + greatest(0, i - 1 - parts + longer) + off")).withColumn("size", F.expr("base + if(i > parts - longer, 1, 0)"))
    rows = rows.where("at >= 1 and at + size <= n + 1")
    piece = "if(raw is null, cast(substring(line, at, size) as binary), substring(raw, at, size))"
    return rows.select(F.expr(f"xxhash64(length, i, {piece})").alias("key"), F.expr("if(shift = 0, id | 1L, id)").alias("code"), "sign")


def _permitting(t: int, tau: int, per: int, length: str) -> str:
    """SQL: whether lines of that length permit t edits and no more."""
    return f"{length} >= {per * t}" + (f" and {length} < {per * (t + 1)}" if t < tau else "")


def edit_within(a: str, b: str, tau: int) -> str:
    """SQL: whether arrays of characters a and b, of lengths differing by tau at most, are within tau edits."""
    stride, band = 2 * tau + 4, 2 * tau + 1
    mask = sum(((1 << band) - 1) << (stride * e) for e in range(tau + 1))
    spread = sum(1 << (stride * e) for e in range(tau + 1))

    def closed(x: str) -> str:  # characters of b alone: one diagonal up, one error more, tau times at most
        return "(" + " | ".join(f"shiftleft({x}, {(stride + 1) * e})" if e else x for e in range(tau + 1)) + f") & {mask}L"

    start = sum(1 << (tau + e + stride * e) for e in range(tau + 1))
    match = " | ".join(f"if(get({b}, i - {tau - j}) <=> get({a}, i), {1 << j}L, 0L)" for j in range(band))
    # Kept where the characters match; a substitution keeps the diagonal, a character of a alone goes one down.
    step = f"((s & (({match}) * {spread}L)) | ((shiftleft(s, {stride}) | shiftleft(s, {stride - 1})) & {mask}L))"
    moved = f"transform(array({step}), x -> {closed('x')})[0]"
    last = "(" + " | ".join(f"shiftright(z, {stride * e})" if e else "z" for e in range(tau + 1)) + ")"
    return f"""aggregate(if(size({a}) = 0, array(), sequence(0, size({a}) - 1)), {start}L, (s, i) -> if(s = 0, 0L, {moved}),
        z -> (shiftright({last}, size({b}) - size({a}) + {tau}) & 1) = 1)"""


def _chars(x: str) -> str:
    return f"filter(split({x}, ''), c -> c <> '')"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is evaluated once (a column would be copied into each place of use)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def close_pairs(pairs: DataFrame, tau: int, per: int = 0) -> DataFrame:
    """(u, v) of the rows of pairs(u, v, a, b) whose lines a and b are within the edits they permit: one for every per
    characters of the shorter, tau at most."""
    steps = "array(" + ", ".join(str(1 << k) for k in range(20, -1, -1)) + ")"
    # Lengths of the common beginning p and end q, by halving.
    head = f"aggregate({steps}, 0, (r, d) -> if(r + d <= least(m.a, m.b) and substring(a, 1, r + d) = substring(b, 1, r + d), r + d, r))"
    tail = f"aggregate({steps}, 0, (r, d) -> if(r + d <= least(m.a, m.b) - p and substring(a, m.a - r - d + 1, r + d) = substring(b, m.b - r - d + 1, r + d), r + d, r))"
    rest = f"struct({_chars('substring(a, p + 1, m.a - p - q)')} as a, {_chars('substring(b, p + 1, m.b - p - q)')} as b)"
    within = edit_within("w.a", "w.b", tau)
    for t in range(tau - 1, 0, -1) if per else ():
        within = f"if(least(m.a, m.b) >= {per * (t + 1)}, {within}, {edit_within('w.a', 'w.b', t)})"
    close = _let("p", head, _let("q", tail, _let("w", rest, within)))
    return pairs.where(F.expr(_let("m", "struct(length(a) as a, length(b) as b)", f"abs(m.a - m.b) <= {tau} and {close}"))).select("u", "v")


def parities() -> str:
    """SQL: 64 parities of hashed pairs of neighbouring characters of line."""
    pairs = "aggregate(if(size(c) < 2, array(), sequence(0, size(c) - 2)), 0L, (s, i) -> s ^ shiftleft(1L, cast(xxhash64(get(c, i), get(c, i + 1)) & 63L as int)))"
    return _let("c", _chars("line"), pairs)


def _bits_of(ids: DataFrame) -> DataFrame:
    """(w, bits): a table of which ids (column id) may be there; BIT_WORDS rows at most."""
    rows = ids.select(F.expr(f"shiftright(id, 1) & {BIT_WORDS - 1}L").alias("w"), F.expr("shiftleft(1L, cast(shiftright(id, 20) & 63L as int))").alias("bit"))
    return rows.groupBy("w").agg(F.bit_or("bit").alias("bits"))


def _maybe(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df with held: whether its id may be one of ids."""
    held = F.expr("coalesce(shiftright(bits, cast(shiftright(id, 20) & 63L as int)) & 1L = 1L, false)")
    return df.withColumn("w", F.expr(f"shiftright(id, 1) & {BIT_WORDS - 1}L")).join(F.broadcast(_bits_of(ids)), "w", "left").withColumn("held", held).drop("w", "bits")


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key (hash of the text), line_no from 0, line; one row for each line."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


#: The lowest bit of a line's hash is left free to mark probes of equal length.
_ID = "(xxhash64(line) & -2L)"
_OTHER = "(xxhash64('other', line) & -2L)"


def _told_apart(df: DataFrame, clashes: DataFrame) -> DataFrame:
    """df with other as id where several lines share the id."""
    shared = clashes.select(F.col("id").alias("shared"))
    return df.join(shared, F.col("id") == F.col("shared"), "left").withColumn("id", F.expr("if(shared is null, id, other)")).drop("shared", "other")


def similar_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = THRESHOLD, per: int = EDIT_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct lines that occur again or have a link, as (id, class_id, n_links); all links (u, v); and the hashes that
    several lines share, which have another as id."""
    if tau < 1 or per < 2:
        raise ValueError("lines need an edit at least and two characters for each")
    lines = lines_of(df, id_col, text_col).where(F.expr("trim(line) <> ''"))
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("copies")).select(F.expr(_ID).alias("id"), F.expr(_OTHER).alias("other"), "line", "copies", F.length("line").alias("n"))
    levels = range(1, tau + 1)
    own_of = "case " + " ".join(f"when {_permitting(t, tau, per, 'n')} then array({', '.join(_own(t))})" for t in levels) + " end"
    hashed = written(counted.withColumn("own", F.expr(own_of)), "lines-distinct")
    clashes = written(hashed.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("id"), "lines-clashes")
    distinct = _told_apart(hashed, clashes)
    long = distinct.where(F.col("n") >= per)
    own_keys = F.explode("own").alias("key")
    crowded = written(hashed.where(F.col("n") >= per).select(own_keys).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "lines-crowded")
    crowd = written(narrowed(long.select("id", own_keys), "key", crowded, "key").join(crowded, "key").select("id").distinct(), "lines-crowd")
    marked = _maybe(long, crowd).withColumn("sign", F.expr(f"if(held, {parities()}, null)"))
    own = marked.select("id", "sign", own_keys)
    probe = probed(marked, tau, per)
    alike = f"coalesce(bit_count(o.sign ^ p.sign) <= {4 * tau}, true)"
    met = own.alias("o").join(probe.alias("p"), "key").where(f"o.id <> (p.code & -2L) and ((p.code & 1L) = 0 or o.id < (p.code & -2L)) and {alike}")
    pairs = written(met.select(F.col("o.id").alias("u"), F.expr("p.code & -2L").alias("v")).distinct(), "lines-pairs")
    texts = _maybe(long, pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))).where("held").select("id", "line")
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("line").alias("b")), "v")
    links = written(close_pairs(both, tau, per), "lines-links")
    roots = components(links, "lines-classes")
    degree = links.select(F.col("u").alias("id")).unionByName(links.select(F.col("v").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    again = distinct.where("copies > 1").select("id").unionByName(degree.select("id")).distinct()
    known = again.join(degree, "id", "left").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return written(known, "lines-known"), links, clashes


def line_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = THRESHOLD, per: int = EDIT_CHARS) -> DataFrame:
    """Per line of every row: doc_id, row_key, line_no, class_id, n_links, removed."""
    known, _, clashes = similar_lines(df, id_col, text_col, tau, per)
    lines = lines_of(df, id_col, text_col).select("doc_id", "row_key", "line_no", F.expr(f"if(trim(line) <> '', {_ID}, null)").alias("id"), F.expr(_OTHER).alias("other"))
    lines = _told_apart(lines, clashes)
    hits = written(lines.where("id is not null").join(known, "id"), "lines-hits")
    firsts = written(hits.where("doc_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "line_no")).alias("first")), "lines-firsts")
    judged = hits.join(firsts, "class_id", "left").select("doc_id", "row_key", "line_no", "class_id", "n_links", F.expr("first is not null and not (doc_id <=> first.doc_id and line_no = first.line_no)").alias("removed"))
    rest = lines.join(known.select("id"), "id", "left_anti").select("doc_id", "row_key", "line_no", F.col("id").alias("class_id"), F.when(F.col("id").isNotNull(), F.lit(0)).cast("long").alias("n_links"), F.lit(False).alias("removed"))
    return judged.unionByName(rest)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = THRESHOLD, per: int = EDIT_CHARS) -> DataFrame:
    """All rows of df, columns unchanged, their texts without the lines that are kept elsewhere (n_chars, if there, told anew)."""
    gone = line_classes(df, id_col, text_col, tau, per).where("removed")
    gone = written(gone.groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("numbers")), "lines-gone")
    # A row travels as one struct, so no name of its columns can clash with those of gone.
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["doc_id"]) & (rows["hash"] == gone["row_key"]), "left").select("row", "numbers")
    text = f"row.`{text_col}`"
    kept = _let("l", f"split({text}, '\\n')", "array_join(transform(array_except(sequence(0, size(l) - 1), numbers), i -> get(l, i)), '\n')")
    out = joined.select("row", "numbers", F.expr(f"if(numbers is null, {text}, {kept})").cast(df.schema[text_col].dataType).alias("kept"))

    def told(name: str):
        if name == text_col:
            return F.col("kept")
        if name == "n_chars":
            return F.when(F.col("numbers").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(df.schema[name].dataType)
        return F.col(f"row.`{name}`")

    return out.select(*[told(c).alias(c) for c in df.columns])
