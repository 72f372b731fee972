"""SimHash near-duplicates by pivot distance tables.

Fingerprints come from numpy (one pandas UDF over the texts); equal fingerprints are folded before anything
is paired. For each distinct fingerprint the Hamming distances to PIVOTS reference fingerprints are
tabulated, eight to a long. The distance to a pivot moves by at most the number of bits in which two
fingerprints differ, so a pair whose rows differ by more than MAX_BITS at any coordinate is discarded without
loss; the survivors are verified bit by bit.

A maximum coordinate difference is no equality, so the table alone can't drive a join without comparing all
with all. Pairs meet by pigeonhole instead: fingerprints at most 2 bits apart are equal in two of four bands of
16 bits (6 band pairs, an equi-join, nothing lost).

A band pair shared by more than BUCKET_LIMIT fingerprints isn't paired out. Its members emit themselves and
their 64 one-bit neighbours instead; fingerprints at most 2 apart share such a neighbour and all that
share one are at most 2 apart, so each shared neighbour yields a star, at most 65 wide. This is exact too,
and linear in the members.

Documents get their group's least id by an equi-join on the fingerprint. Fingerprints that hold more than one
in HOT of all rows, HOT at most, are joined by broadcast; so no common text gathers in one task.

Defined cases: null and empty texts have fingerprint zero and link like any other; very long texts are hashed
whole, in chunks; repeated rows repeat; null ids never become a component's id unless all of it is null; an
empty table gives an empty result; other columns are ignored or, where rows are kept, returned as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, if_small, stored

MAX_BITS, BUCKET_LIMIT, SEED, PIVOTS, HOT = 2, 32, 42, 32, 10_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    total, ones = max(1, len(words) - n + 1), np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):  # bounded memory for texts of any length
        some = words[at : at + _CHUNK + n - 1]
        joined, sizes = b" ".join(some), np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(sizes + 1) - 1
        k = max(1, len(some) - n + 1)
        starts, stops = (ends - sizes)[:k].tolist(), ends[min(n, len(some)) - 1 :].tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, k)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _of_texts(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(texts: Column) -> Column:
    """The fingerprints as longs, from Arrow batches."""
    return F.pandas_udf(_of_texts, LongType())(texts.cast("string"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints, from a seed."""
    rng = np.random.default_rng(20240607)
    return [int(rng.integers(0, 1 << 64, dtype=np.uint64)) for _ in range(n)]


def _tabulated(fps: DataFrame) -> DataFrame:
    """fp, coords (its distances to the pivots, a byte each, eight to a long), keys (band pairs, hashed)."""
    longs = [" | ".join(f"shiftleft(bit_count(fp ^ {_signed(r)}L)::bigint, {8 * i})" for i, r in enumerate(pivots()[at : at + 8])) for at in range(0, PIVOTS, 8)]
    pairs = ", ".join(f"xxhash64({i}, shiftrightunsigned(fp, {16 * a}) & 65535, shiftrightunsigned(fp, {16 * b}) & 65535)" for i, (a, b) in enumerate(combinations(range(4), 2)))
    return fps.selectExpr("fp", *[f"{x} AS coords{i}" for i, x in enumerate(longs)], f"array({pairs}) AS keys")


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all pairs at most MAX_BITS apart, and no others."""
    table = _tabulated(fps)
    coords = [c for c in table.columns if c.startswith("coords")]
    keyed = table.select("fp", F.explode("keys").alias("key"), *coords)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, "key"), "shared")
    cold, hot = shared.where(F.col("n") <= bucket_limit), shared.where(F.col("n") > bucket_limit)
    a = cold.select("key", F.col("fp").alias("a"), *[F.col(c).alias(f"a_{c}") for c in coords])
    b = cold.select("key", F.col("fp").alias("b"), *[F.col(c).alias(f"b_{c}") for c in coords])
    far = " OR ".join(f"abs((shiftrightunsigned(a_{c}, {s}) & 127) - (shiftrightunsigned(b_{c}, {s}) & 127)) > {MAX_BITS}" for c in coords for s in range(0, 64, 8))
    pairs = a.join(b, "key").where("a < b").where(f"NOT ({far})").where(f"bit_count(a ^ b) <= {MAX_BITS}").select("a", "b")
    near = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    stars = hot.select("fp").distinct().select("fp", F.explode(near).alias("near")).groupBy("near").agg(F.collect_list("fp").alias("of")).where("size(of) > 1")
    stars = stars.select(F.array_min("of").alias("a"), F.explode("of").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def _groups(rows: DataFrame) -> DataFrame:
    """rows: (fp, _first) with _first comparable, nulls last already. Per distinct fp the number of its rows and the least _first of its component."""
    folded = stored(rows.groupBy("fp").agg(F.min("_first").alias("_first"), F.count("*").alias("_rows")), "fingerprints")
    roots = components(links(folded.select("fp"))).select(F.col("node").alias("fp"), "root")
    linked = folded.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    linked = linked.join(least, "root").select("fp", "_least")
    return stored(folded.join(linked, "fp", "left").select("fp", "_rows", F.coalesce("_least", "_first").alias("_least")), "groups")


def _with_groups(rows: DataFrame, groups: DataFrame, hot: int = HOT) -> DataFrame:
    """rows, which are stored, with the _least of their fingerprint's group; the few fingerprints of very many rows by broadcast."""
    common = F.col("_rows") > F.lit(rows.count() / hot)  # so there are fewer than `hot`
    groups = groups.select("fp", "_least", common.alias("_common"))
    wide = groups.where("_common").select("fp", F.col("_least").alias("_known"), F.lit(True).alias("_done"))
    rows = rows.join(F.broadcast(wide), "fp", "left")
    done = rows.where("_done").withColumnRenamed("_known", "_least").drop("_done")
    rest = rows.where("_done IS NULL").drop("_known", "_done").join(groups.where("NOT _common").select("fp", "_least"), "fp")
    return done.unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("_first"), fingerprints(F.col(f"`{text_col}`")).alias("fp")), "simhash")
    out = _with_groups(rows, _groups(rows))
    return out.select(F.col("_first").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_least").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest id, and of equal ids one row.

    The rows that go are found on narrow columns. Their list is broadcast if it is counted to be small; else
    the texts are shuffled by row number, evenly.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, fingerprints(F.col(f"`{text_col}`")).alias("fp"), F.monotonically_increasing_id().alias("_n"))
    rows = stored(rows, "simhash")  # from here on _n stands still
    ident = F.col(f"_row.`{id_col}`")
    first = rows.select("fp", F.struct(ident.isNull().alias("no"), ident.alias("id"), F.col("_n").alias("n")).alias("_first"))
    kept = _groups(first).select(F.col("_least.n").alias("_n")).distinct()
    gone = stored(rows.select("_n").join(kept, "_n", "left_anti"), "gone")
    return rows.join(if_small(gone), "_n", "left_anti").select("_row.*")
