"""Phrases whose words stand together more than their parts would, per language.

1. A sketch with one row of counters takes in every word and every phrase of two and three words, by hash. A counter is
   never under the count of what falls into it. Only whether it reaches LEAST matters afterwards: one bit each.
2. Each task takes its texts in shards. What occurs in a shard, and whose counters (and those of all its parts) reach
   LEAST, is compiled into an Aho-Corasick automaton, each phrase between delimiters, so that it is found at ends of words
   only. The automaton runs over the shard and counts overlapping matches; Spark adds the shards' counts up.
3. Sums under LEAST go: what is left is exact, as a phrase that reaches LEAST is counted in every shard it stands in.
4. Scores are computed in decimals of 38 places, by joins of phrases with their parts.

Memory: a task holds a shard's words and automaton (READ bytes of texts of one language, or one longer text). The bits are
broadcast: a counter for each 4 bytes of text, 2**CELLS at most (64 MB of bits). Beyond some 2 GB of texts the bits
thin out less and more phrases are counted and shuffled that don't reach LEAST in the end: up to all that occur in
a shard, which grows with the input as it should.

Defined cases: null texts are empty, null languages are 'und'; very long texts are read whole; repeated rows count
again; ties rank by count, then by the phrase's bytes; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import buffers
from .common import if_small, is_small, stored

#: Occurrences a phrase must have, the longest phrase, the share (percent) of a longer phrase that makes it redundant, phrases of a language.
LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2000
#: Bytes of a shard; log2 of the most counters; counters of a block; entries that a task gathers before it passes them on.
READ, CELLS, BLOCK, GATHERED = 4 << 20, 29, 1 << 16, 4 << 20
#: Salts for the joins on hot parts and for the first selection of the best.
SALTS = 16
#: Classes of bytes: words, and separators of pieces; space and tab are neither.
PIECE = np.zeros(256, bool)
PIECE[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
WORD = ~PIECE
WORD[[9, 32]] = False
_BLANK = bytes(i if WORD[i] else 32 for i in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers


class _Numbers(dict):
    """Words by the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Shard:
    """Words of texts of one language, numbered, and the pieces they stand in."""

    def __init__(self, lang: str, data: np.ndarray, edges: np.ndarray):
        data = np.insert(data, edges[1:-1], ord("\n"))  # texts end pieces
        inside, numbers = WORD[data], _Numbers()
        self.ids = np.fromiter(map(numbers.__getitem__, data.tobytes().translate(_BLANK).split()), np.int64)
        self.keys = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        self.names = [w.decode("latin-1") for w in numbers]
        piece = np.cumsum(PIECE[data], dtype=np.int32)[inside & ~np.concatenate([[False], inside[:-1]])]
        self.ahead = [piece[: len(piece) - k] == piece[k:] for k in range(LONGEST)]  # whether the word k on is in the same piece
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def _hash(self, so_far: np.ndarray | np.uint64, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (so_far ^ keys) * _A
            x = (x ^ (x >> np.uint64(32))) * _B
            return x ^ (x >> np.uint64(29))

    def hashes(self) -> Iterator[np.ndarray]:
        """Of the phrases of 1, 2, ... words that begin at each word; those that leave their piece are to be left out by `ahead`."""
        h, words = self.seed, self.keys[self.ids]
        for k in range(LONGEST):
            h = self._hash(h[: len(words) - k] if k else h, words[k:])
            yield h

    def cells(self, mask: int) -> np.ndarray:
        """The counter of every occurrence of every phrase."""
        return np.concatenate([(h & np.uint64(mask))[ok] for h, ok in zip(self.hashes(), self.ahead, strict=True)])

    def candidates(self, bits: np.ndarray, mask: int) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
        """Which words reach the threshold by their counter; by number of words from 2 on, the different phrases that do, and all their parts; which words of the text stand in any."""

        def reach(h: np.ndarray) -> np.ndarray:
            cell = h & np.uint64(mask)
            return (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        hashes = self.hashes()
        next(hashes)
        words = reach(self._hash(self.seed, self.keys))
        passed, number, out, covered = words[self.ids], self.ids, [], np.zeros(len(self.ids), bool)
        for k, (h, ok) in enumerate(zip(hashes, self.ahead[1:], strict=True), 1):
            at = np.flatnonzero(ok & passed[:-1] & passed[1:])
            at = at[reach(h[at])]
            # A phrase is numbered by its first k words' number and its last word.
            _, first, inverse = np.unique(number[at] * len(self.names) + self.ids[at + k], return_index=True, return_inverse=True)
            passed, number = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
            passed[at], number[at] = True, inverse
            for j in range(k + 1):
                covered[at + j] = True
            out.append([" ".join([self.names[i] for i in some]) for some in self.ids[at[first][:, None] + np.arange(k + 1)].tolist()])
        return words, out, covered

    def count(self, bits: np.ndarray, mask: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Candidates and single words that may be their parts, their numbers of words and of occurrences."""
        words, by_length, covered = self.candidates(bits, mask)
        phrases = [p for ps in by_length for p in ps]
        singles = np.flatnonzero(words)
        sizes = np.repeat(np.arange(1, LONGEST + 1), [len(singles), *map(len, by_length)])
        n = np.bincount(self.ids, minlength=len(words))[singles]
        if phrases:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, p in enumerate(phrases):
                automaton.add_word(f" {p} ", i)
            automaton.make_automaton()
            # Words outside of all candidates are left out; a line end stands where a piece ends or words are missing.
            at = np.flatnonzero(covered)
            gaps = np.flatnonzero((np.diff(at) > 1) | ~self.ahead[1][at[:-1]]) + 1
            shown = np.array([*self.names, "\n"], object)
            text = f" {' '.join(shown[np.insert(self.ids[at], gaps, len(self.names))])} "
            n = np.append(n, np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(phrases)))
        return [*(self.names[i] for i in singles), *phrases], sizes, n


def shards(batch: pa.RecordBatch) -> Iterator[tuple[str, Shard]]:
    """(lang, text) by language, READ bytes each."""
    langs = batch.column(0).to_numpy(zero_copy_only=False)
    for lang in dict.fromkeys(langs):
        for _, _, data, edges in buffers(batch.column(1).take(pa.array(np.flatnonzero(langs == lang))), READ):
            yield lang, Shard(lang, data, edges)


def _add(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_cells = np.concatenate(cells)
    order = np.argsort(all_cells, kind="stable")
    all_cells, n = all_cells[order], np.concatenate(counts)[order]
    heads = np.flatnonzero(np.diff(all_cells, prepend=-1)) if len(all_cells) else np.zeros(0, np.int64)
    return all_cells[heads], np.minimum(np.add.reduceat(n, heads), 255) if len(heads) else n


def sketch(rows: DataFrame, least: int, cells: int) -> np.ndarray:
    """One bit for each counter: whether it reaches `least`, which is 255 at most."""
    if not 0 < least < 256:
        raise ValueError("counters end at 255")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed_on(held):
            at, n = _add(*zip(*held, strict=True))
            block = at // BLOCK
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cuts[1:], len(at))
            low, n = (at % BLOCK).astype(np.uint16), n.astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int32)), pa.array([low[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["block", "cells"])

        held, size = [], 0
        for batch in batches:
            for _, shard in shards(batch):
                at, n = np.unique(shard.cells(cells - 1).astype(np.int64), return_counts=True)
                held.append((at, np.minimum(n, 255)))
                size += len(at)
                if size > GATHERED:
                    yield passed_on(held)
                    held, size = [], 0
        if held:
            yield passed_on(held)

    def total(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for f in frames:
            for block, raw in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True):
                n = len(raw) // 3
                own = counters.setdefault(block, np.zeros(BLOCK, np.uint8))
                at = np.frombuffer(raw, np.uint16, n)
                own[at] = np.minimum(own[at].astype(np.int64) + np.frombuffer(raw, np.uint8, n, 2 * n), 255)
        for block, own in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    parts = max(1, cells // BLOCK // 64)  # so many blocks a task: 4 MB of counters
    found = rows.mapInArrow(take, "block int, cells binary").repartition(parts, "block").mapInArrow(total, "block int, bits binary")
    bits = np.zeros((cells // BLOCK, BLOCK // 8), np.uint8)
    for r in found.toLocalIterator():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def counts(rows: DataFrame, least: int, cells: int) -> DataFrame:
    """(lang, phrase, size, n): every phrase of `least` occurrences or more, with its number of words; size 0 and phrase '' have the language's words."""
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, least, cells).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for lang, shard in shards(batch):
                phrases, sizes, n = shard.count(known, cells - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(phrases) + 1)), pa.array([p.encode("latin-1") for p in phrases] + [b""], pa.binary()), pa.array(np.append(sizes, 0).astype(np.int32)), pa.array(np.append(n, len(shard.ids)).astype(np.int64))],
                    ["lang", "phrase", "size", "n"],
                )

    found = rows.mapInArrow(run, "lang string, phrase binary, size int, n bigint").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | (F.col("size") == 0)).withColumn("phrase", F.col("phrase").cast("string"))


def _with_part(df: DataFrame, parts: DataFrame, part: str, out: str) -> DataFrame:
    """df with the count of its column `part`; a part that very many phrases share is salted where the table of parts is too large to broadcast."""
    parts = parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(out))
    if is_small(parts):
        return df.join(F.broadcast(parts), ["lang", part])
    salted = parts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(salted, ["lang", part, "_salt"]).drop("_salt")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Per language the `top` phrases: lang, rank, phrase, a (its count), l and r (those of its parts), n (words of the language), score."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = stored(counts(rows, least, 1 << min(CELLS, max(16, (size // 4).bit_length()))), "phrases")

    words = F.split("phrase", " ")
    some = found.where("size >= 2").withColumnRenamed("n", "a")
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    halves = some.select("lang", "phrase", "size", "a", cuts).select(
        "lang", "phrase", "size", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("right"),
    )
    parts = found.where(F.col("size").between(1, LONGEST - 1)).select("lang", "phrase", "n")
    halves = _with_part(_with_part(halves, parts, "left", "l"), parts, "right", "r")
    exact = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast((cast(cast(1000000 as decimal(7,0)) * {exact('a')} as decimal(26,0)) * {exact('a')}) div ({exact('l')} * {exact('r')}) as bigint)")
    least_cut = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m")
    scored = halves.groupBy("lang", "phrase", "size", "a").agg(least_cut).select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")

    # The greatest count among the longer candidates around each phrase.
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))))
    around = some.where("size > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    scored = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64 * SALTS))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = found.where("size = 0").select("lang", "n")
    return scored.join(if_small(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
