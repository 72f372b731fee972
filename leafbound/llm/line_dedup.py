"""Line dedup: an edit-distance join of lines by segment partition (native).

Lines of MIN_CHARS code points or more (white space at their ends aside) are folded to distinct lines. Each
is split into EDITS + 1 segments; of two lines at most EDITS apart one segment must recur unchanged, at an
offset that the length difference and the segment's number bound. So segments, hashed with length and
number, index the lines, and each line probes them with those substrings of its own, for lengths from
EDITS less up to its own. Keys that one line alone has are dropped before anything is paired.

A key shared by more than BUCKET_LIMIT lines isn't paired out when EDITS is 1. Its lines get finer keys
instead: the whole line but one of PIECES pieces, which one edit leaves alone too. What meets is verified
with a banded bit-parallel edit distance (three bits a step), written as a fold.

Linked lines form classes; of each class the first occurrence by document id and line number stays. A
line that very many documents have is a partial minimum in every task, and never one task's work: firsts
are matched to their places by row and line number, and lines to their classes by broadcast or salted joins.

Defined cases: null and empty texts have no lines; short lines are never touched; null ids come last; of
rows with equal ids, the one read first comes first; repeated rows lose their lines to the first; an empty
table gives an empty result; `keep_lines` keeps other columns, whatever their names.
Very long lines take as many steps as they have characters, in one row; very long texts are one row's lines.
Lines are told apart by 128-bit hashes, but no link is made without comparing the lines themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, if_small, join_skewed, stored

EDITS, MIN_CHARS, BUCKET_LIMIT, PIECES = 1, 20, 16, 16


def _bounds(length: str, k: int, i: int) -> tuple[str, str]:
    """Start and size of segment i (from 0) of k: equal segments, the last takes what is over."""
    return f"{i} * (({length}) div {k})", (f"({length}) div {k}" if i < k - 1 else f"({length}) - {k - 1} * (({length}) div {k})")


def _segment_keys(edits: int) -> tuple[list[str], list[str]]:
    """SQL for the keys under which a line (column line, n characters) is indexed, and under which it looks for others."""
    own, probes, k = [], [], edits + 1
    for diff in range(edits + 1):  # it is longer by diff than the line it looks for
        for i in range(k):
            at, size = _bounds(f"n - {diff}", k, i)
            for shift in range(max(-i, diff - (edits - i)), min(i, diff + (edits - i)) + 1):
                key = f"CASE WHEN n - {diff} >= {MIN_CHARS} AND {at} + {shift} >= 0 THEN xxhash64(n - {diff}, {i}, substring(line, {at} + {shift} + 1, {size})) END"
                (own if diff == shift == 0 else probes).append(key)
    return own, probes


def _piece_keys() -> tuple[list[str], list[str]]:
    """The same for one edit and finer keys: all of the line but one piece."""
    out: tuple[list[str], list[str]] = ([], [])
    for diff in (0, 1):
        for i in range(PIECES):
            at, size = _bounds(f"n - {diff}", PIECES, i)
            out[diff].append(f"CASE WHEN n - {diff} >= {MIN_CHARS} THEN xxhash64(n - {diff}, {i}, substring(line, 1, {at}), substring(line, {at} + {size} + {diff} + 1)) END")
    return out


def _shared(lines: DataFrame, own: list[str], probes: list[str]) -> DataFrame:
    """(key, lid, owner, size) of keys that several lines have; lines: (lid, line, n)."""
    rows = lines.select("lid", F.explode(F.expr(f"array({', '.join(f'named_struct("key", {x}, "owner", {o})' for xs, o in ((own, 'true'), (probes, 'false')) for x in xs)})")).alias("k"))
    rows = rows.select("lid", "k.key", "k.owner").where("key IS NOT NULL")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("owner").alias("any")).where("size > 1 AND any").select("key", "size")
    return stored(rows.join(if_small(stored(sizes, "keys")), "key"), "shared")


def _meeting(shared: DataFrame) -> DataFrame:
    a = shared.where("owner").select("key", F.col("lid").alias("x"))
    b = shared.select("key", F.col("lid").alias("y"))
    return a.join(b, "key").where("x <> y").selectExpr("least(x, y) a", "greatest(x, y) b").distinct()


def within(x: str, y: str, edits: int) -> Column:
    """Whether two string columns are at most `edits` apart: Myers' bit vectors over a band of 2 * edits + 1 diagonals.

    Bit b of the vectors at step j stands for row j - edits + b of the pattern x. The distance d is followed
    down the band's lowest diagonal to the pattern's last row, then along that row. In the SQL, a one-element
    transform names a value that is used several times.
    """
    k, full = edits, (1 << (2 * edits + 1)) - 1
    match = " | ".join(f"IF(get(s.p, j - {k} + {b}) = get(s.t, j), {1 << b}, 0)" for b in range(2 * k + 1))
    moved = f"""named_struct(
        'vp', (h.hn | ~(shiftright(h.d0, 1) | h.hp)) & {full}, 'vn', shiftright(h.d0, 1) & h.hp,
        'd', acc.d + IF(j + {k} < size(s.p), 1 - (shiftright(h.d0, {2 * k}) & 1),
            (shiftright(h.hp, size(s.p) - 1 - j + {k}) & 1) - (shiftright(h.hn, size(s.p) - 1 - j + {k}) & 1)))"""
    across = f"named_struct('d0', d0, 'hp', (acc.vn | ~(d0 | acc.vp)) & {full}, 'hn', d0 & acc.vp)"
    d0 = f"((((pm & acc.vp) + acc.vp) ^ acc.vp) | pm | acc.vn) & {full}"
    step = f"transform(array({match}), pm -> transform(array({d0}), d0 -> transform(array({across}), h -> {moved})[0])[0])[0]"
    # before the first step the rows from 0 on grow by one each, and there are none above them
    fold = f"aggregate(sequence(0, size(s.t) - 1), named_struct('vp', {(full << k) & full}, 'vn', 0, 'd', {k}), (acc, j) -> {step}, acc -> acc.d)"
    distance = f"transform(array(named_struct('p', split({x}, ''), 't', split({y}, ''))), s -> {fold})[0]"
    short = f"char_length({x}) <= {k} OR char_length({y}) <= {k}"
    return F.expr(f"CASE WHEN abs(char_length({x}) - char_length({y})) > {k} THEN false WHEN {short} THEN levenshtein({x}, {y}) <= {k} ELSE {distance} <= {k} END")


def links(lines: DataFrame, edits: int = EDITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (a, b) of lids of all lines (lid, line, n) at most `edits` apart; lines is stored and distinct."""
    shared = _shared(lines, *_segment_keys(edits))
    used = [shared]
    if edits == 1:
        hot = stored(shared.where(F.col("size") > bucket_limit).select("lid").distinct(), "hot")
        fine = _shared(lines.join(if_small(hot), "lid", "left_semi"), *_piece_keys())
        met = _meeting(shared.where(F.col("size") <= bucket_limit)).union(_meeting(fine)).distinct()
        used += [hot, fine]
    else:
        met = _meeting(shared)
    met = stored(met, "met")
    ids = stored(met.select(F.explode(F.array("a", "b")).alias("lid")).distinct(), "ids")
    texts = stored(lines.join(if_small(ids), "lid").select("lid", "line"), "texts")
    x, y = texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), texts.select(F.col("lid").alias("b"), F.col("line").alias("y"))
    found = stored(met.join(x, "a").join(y, "b").where(within("x", "y", edits)).select("a", "b"), "links")
    discard(*used, met, ids, texts)
    return found


def _occurrences(rows: DataFrame, edits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: (_n, _id, _text). All rows (_n, _id); all long lines (_n, at, lid, class, n_links); and of each class its first occurrence (class, n, at, lid).

    Rows and lines come from one stored table: a number that is worked out twice may fall on another row."""
    trimmed = F.expr(f"""filter(transform(split(coalesce(_text, ''), '\n'), (l, i) -> struct(i AS at, regexp_replace(l, '^[ \t\x0b\x0c\r]+|[ \t\x0b\x0c\r]+$', '') AS line)), x -> char_length(x.line) >= {MIN_CHARS})""")
    lid = F.unhex(F.md5(F.col("l.line").cast("binary")))
    row = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("line")))  # stands for the row itself
    seen = stored(rows.select("_n", "_id", F.explode(F.concat(row, trimmed)).alias("l")).select("_n", "_id", "l.at", lid.alias("lid")), "occurrences")
    ids, seen = seen.where("at < 0").select("_n", "_id"), seen.where("at >= 0")
    lines = rows.select(F.explode(trimmed).alias("l")).select(lid.alias("lid"), "l.line").groupBy("lid").agg(F.first("line").alias("line"))
    lines = stored(lines.withColumn("n", F.char_length("line")), "lines")
    pairs = links(lines, edits)
    discard(lines)
    roots = components(pairs).selectExpr("node lid", "root")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("lid")).groupBy("lid").agg(F.count("*").alias("n_links"))
    linked = stored(roots.join(degree, "lid"), "linked")
    seen = join_skewed(seen, linked, "lid", F.col("_n")).select("_n", "_id", "at", "lid", F.coalesce("root", "lid").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    order = F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_n").alias("n"), F.col("at").alias("at"), F.col("lid").alias("lid"))
    firsts = stored(seen.groupBy("class").agg(F.min(order).alias("f")).select("class", "f.n", "f.at", "f.lid", F.lit(True).alias("first")), "firsts")
    return ids, seen, firsts


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """Per document: id, n_lines (long ones), n_exact and n_near (lines that go, as copies or near copies of an earlier line), n_links (links of its lines to other texts), line_classes (the class of each of its long lines, in order: the least of its lines' hashes)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_n"))
    ids, seen, firsts = _occurrences(rows, edits)
    kept = firsts.groupBy(F.col("n").alias("_n")).agg(F.count("*").alias("n_first"))
    own = seen.groupBy("_n").agg(F.count("*").alias("n_lines"), F.sum("n_links").alias("n_links"), F.sort_array(F.collect_list(F.struct("at", "class"))).alias("c"))
    # only lines with links can be near copies
    linked = seen.where("n_links > 0")
    heads = stored(firsts.join(linked.select("class").distinct(), "class", "left_semi").select("class", F.col("lid").alias("head")), "heads")
    near = join_skewed(linked, heads, "class", F.col("_n"), "inner").where("lid <> head").groupBy("_n").agg(F.count("*").alias("n_near"))
    out = ids.join(own, "_n", "left").join(kept, "_n", "left").join(near, "_n", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    classes = F.coalesce(F.transform("c", lambda x: F.lower(F.hex(x["class"]))), F.array().cast("array<string>"))
    return out.select(F.col("_id").alias(id_col), zero("n_lines").alias("n_lines"), (zero("n_lines") - zero("n_first") - zero("n_near")).alias("n_exact"), zero("n_near").alias("n_near"), zero("n_links").alias("n_links"), classes.alias("line_classes"))


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """docs with the text of each row freed of lines that an earlier row or line has; the columns stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = stored(docs.select(row, F.monotonically_increasing_id().alias("_n")), "rows")
    _, seen, firsts = _occurrences(rows.select("_n", F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text")), edits)
    gone = seen.join(firsts.select(F.col("n").alias("_n"), "at", "first"), ["_n", "at"], "left").where("first IS NULL").groupBy("_n").agg(F.collect_set("at").alias("_gone"))
    rows = rows.join(gone, "_n", "left").withColumn("_l", F.split(F.col(f"_row.`{text_col}`"), "\n"))
    kept = F.array_join(F.expr("transform(filter(transform(_l, (l, i) -> struct(l AS l, i AS i)), x -> NOT array_contains(_gone, x.i)), x -> x.l)"), "\n")
    text = F.when(F.col("_gone").isNull(), F.col(f"_row.`{text_col}`")).otherwise(kept)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
