"""How far apart the sources of a language are, by the shares of the terms they use.

Tasks find terms in the joined UTF-8 buffers (byte_words), and count them per source and in how many documents they
stand; Spark adds that up. Terms in few documents of their language go. The shares of the others, whole numbers of
billionths, are dealt out in blocks of terms; each block is a CSR matrix of sources by terms in one task, whose rows are
compared by segment sums (reduceat), and Spark adds up the blocks' distances. A source's row need not name the terms
that it lacks: they all have one share there, so that only entries are visited.

All arithmetic is on whole numbers: shares in decimals of 38 places, distances in 64 bits (a distance is under
2 * 10**9 + the number of kept terms).

Memory: a task holds READ bytes of texts (or one longer text) and one block; sources are compared TILE at a time with all
others of their language, so a block's result is TILE rows of the number of sources.

Defined cases: null texts have no terms, null languages and sources are ''; very long texts are read whole; repeated
rows are documents of their own; a source without terms has its row like any other; a language without kept
terms gives distances of 0; a language of one source has no pairs; equal values rank by item; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import buffers, cut, group, spelled
from .common import if_small, stored

#: Fixed values of the audit: documents of a language that a term must stand in, the count added to each, parts, ranks.
LEAST, ADDED, PARTS, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of text that a task looks at together; terms of a block; sources that are compared with all others at once.
READ, BLOCK, TILE = 8 << 20, 4096, 256
#: Bytes of terms: letters of ASCII and all bytes beyond it.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs): occurrences, and documents that hold the term."""
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, to, data, edges in buffers(batch.column(2), READ):
            names = list(zip(langs[at:to], sources[at:to], strict=True))
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            of_doc = np.array([known[x] for x in names])
            starts, ends = cut(data, edges, TERM)
            ids, first, _ = group(data, starts, ends)
            doc = np.searchsorted(edges, starts, "right") - 1
            cells, n = np.unique(doc * len(first) + ids, return_counts=True)  # documents by terms
            where, slot = np.unique(of_doc[cells // max(1, len(first))] * len(first) + cells % max(1, len(first)), return_inverse=True)
            total, docs = np.bincount(slot, n, len(where)).astype(np.int64), np.bincount(slot, minlength=len(where))
            words, pairs = pa.array(spelled(data, starts, ends, first), pa.binary()), list(known)
            side = [pa.array([p[i] for p in pairs], pa.string()).take(pa.array(where // max(1, len(first)))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*side, words.take(pa.array(where % max(1, len(first)))), pa.array(total), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def compare(names: list[str], base: np.ndarray, row: np.ndarray, term: np.ndarray, share: np.ndarray, width: int, lines: np.ndarray) -> np.ndarray:
    """Distances of the sources `lines` to all sources over one block of `width` terms.

    base: each source's share of a term it lacks; (row, term, share): the entries, ordered by row.
    """
    at = np.searchsorted(row, np.arange(len(names) + 1))
    full, heads = np.flatnonzero(np.diff(at)), at[:-1][np.diff(at) > 0]
    out = np.zeros((len(lines), len(names)), np.int64)
    for k, i in enumerate(lines):
        mine = slice(at[i], at[i + 1])
        dense = np.full(width, base[i])
        dense[term[mine]] = share[mine]
        if len(heads):  # at the others' entries: the true difference in place of that to their base
            other = dense[term]
            out[k, full] = np.add.reduceat(np.abs(share - other) - np.abs(base[row] - other), heads)
        own = np.sort(share[mine])
        total, sums = len(own), np.concatenate([[0], np.cumsum(own)])
        under = np.searchsorted(own, base)
        out[k] += base * under - sums[under] + (sums[total] - sums[under]) - base * (total - under)  # |base - own|, added up
        out[k] += (width - total) * np.abs(base - base[i])
    return out


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block of terms: heads (source, base) of all sources and entries (source, item, share)."""
    heads = rows[rows["item"].isna()]
    names = heads["source"].tolist()
    index = {s: i for i, s in enumerate(names)}
    entries = rows[rows["item"].notna()]
    row = entries["source"].map(index).to_numpy(np.int64)
    order = np.argsort(row, kind="stable")
    term, terms = pd.factorize(entries["item"])
    lines = np.flatnonzero((heads["tile"] == key[2]).to_numpy())
    d = compare(names, heads["share"].to_numpy(np.int64), row[order], term[order], entries["share"].to_numpy(np.int64)[order], len(terms), lines)
    i, j = np.nonzero(np.arange(len(names))[None, :] != lines[:, None])
    named = np.array(names, object)
    return pd.DataFrame({"lang": np.full(len(i), key[0], object), "source": named[lines[i]], "item": named[j], "value": d[i, j]})


def _share(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(PARTS * (n + ADDED) / (total + ADDED * kept)), exactly."""
    return F.expr(f"1 + cast((cast({PARTS} as decimal(10,0)) * cast({n} + {ADDED} as decimal(20,0))) div cast({total} + {ADDED} * {kept} as decimal(20,0)) as bigint)")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """Per language and source: distances to its other sources (part 'pair') and the terms it uses more than its language does (part 'term')."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).alias("text"))
    counts = rows.mapInArrow(count_terms, "lang string, source string, term binary, n bigint, docs bigint")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select("lang", "source", F.col("term").cast("string").alias("item"), "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("in_lang"))
    kept = stored(kept.where(F.col("docs") >= least).drop("docs"), "terms")

    langs = kept.groupBy("lang", "item").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    groups = stored(groups.withColumn("base", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(1)), "sources")
    entries = kept.join(if_small(groups), ["lang", "source"]).withColumn("share", _share("n", "total", "kept")).withColumn("q", _share("in_lang", "lang_total", "kept"))

    # Blocks by terms, tiles by sources; every block has the heads of all sources of its language.
    deal = lambda x, by, n: F.pmod(F.xxhash64(x), F.greatest(F.lit(1), F.ceil(by / n))).cast("int")
    each = lambda by, n: F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(by / n)) - 1).cast("int")))
    parts = entries.select("lang", "source", "item", "share", deal(F.col("item"), F.col("kept"), BLOCK).alias("block"), F.lit(None).cast("int").alias("tile"), each(F.col("sources"), TILE).alias("t"))
    heads = groups.select("lang", "source", "base", "sources", deal(F.col("source"), F.col("sources"), TILE).alias("tile"), each(F.col("kept"), BLOCK).alias("block"))
    heads = heads.select("lang", "source", F.lit(None).cast("string").alias("item"), F.col("base").alias("share"), "block", "tile", each(F.col("sources"), TILE).alias("t"))
    distances = parts.unionByName(heads).groupBy("lang", "block", "t").applyInPandas(_block, "lang string, source string, item string, value bigint")
    distances = distances.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    terms = entries.where(F.col("share") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), "item", (F.col("share") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms)
