"""Benchmark decontamination by a prefix-filtered containment join (native).

Items are cut into windows of WINDOW consecutive words (shorter items are one window). A window can only
occur in a text that has all its words, so its prefix under a rarest-first order is one word: the rarest
one, by occurrences in all documents. Windows of an item that share this anchor are held as one row, and
document words meet the anchors in an equi-join. Length and position bounds discard anchors too near a
text's end, and the windows left are compared word by word.

Items of any length are worked on in pieces of PIECE words, and an anchor's row holds the words around it
alone. The anchors are broadcast when they are few and small (counted first). Otherwise each document word
that is an anchor is shuffled with the words around it, salted, so that no common word is one task's work.

Defined cases: null and empty texts have no words and are clean; items without words are no items; items
without id mark the words that they share, but are not counted or named; repeated rows get each their own,
equal result; texts and items may be of any length; extra columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, is_small, lower_ascii, stored, words

WINDOW, RATIO, ANCHOR_LIMIT, PIECE, SALTS = 13, 20, 200_000, 4096, 8
#: Bounds in bytes of broadcast anchors, in rows and bytes of the broadcast list of anchor words.
ANCHOR_BYTES, WORD_LIMIT, WORD_BYTES = 32 << 20, 1_000_000, 32 << 20
#: Fixed value: what separates words once A-Z is lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _item_words(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, key, iw) of items with words; key tells items apart."""
    items = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), words(lower_ascii(F.col(f"`{text_col}`")), SEPARATORS).alias("iw")).where("size(iw) > 0")
    return items.withColumn("key", F.md5(F.concat(F.coalesce("item", F.lit("\x00")), F.lit("\x01"), F.array_join("iw", " ")).cast("binary"))).dropDuplicates(["key"])


def anchors(texts: DataFrame, items: DataFrame, limit: int = ANCHOR_LIMIT) -> tuple[DataFrame, bool]:
    """(anchor, item, len, at, part, starts): the words part[0..] around the anchor, which is part[at], and the starts in part of the windows of which it is the rarest word; and whether they are few."""
    vocabulary = stored(items.select(F.explode("iw").alias("word")).distinct(), "vocabulary")
    occurring = texts.select(F.explode("words").alias("word"))
    counts = stored(occurring.join(if_small(vocabulary, limit), "word").groupBy("word").agg(F.count("*").alias("n")), "rarity")
    placed = items.select("key", "item", F.size("iw").alias("size"), F.posexplode("iw").alias("q", "word"))
    placed = placed.join(if_small(counts, limit), "word", "left")  # words in no document make the rarest anchors
    reach = WINDOW - 1
    # a piece holds its own words and those within reach on either side
    pieces = F.expr(f"array_distinct(array((q - {reach}) div {PIECE}, q div {PIECE}, (q + {reach}) div {PIECE}))")
    placed = placed.withColumn("piece", F.explode(pieces))
    order = Window.partitionBy("key", "piece").orderBy("q")
    ahead, around = order.rowsBetween(0, reach), order.rowsBetween(-reach, reach)
    placed = placed.select(
        "key", "item", "size", "q", "word", "piece", F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q")).over(ahead).getField("q").alias("rarest"), F.collect_list("word").over(around).alias("part"),
    ).where(f"piece = q div {PIECE}").withColumn("len", F.least(F.lit(WINDOW), "size"))
    placed = stored(placed, "placed")
    windows = placed.where("q <= size - len").groupBy("key", F.col("rarest").alias("q")).agg(F.array_sort(F.collect_list("q")).alias("starts"))
    first = f"greatest(q - {reach}, 0)"  # the item's place of part[0]
    index = placed.join(windows, ["key", "q"]).select(
        F.col("word").alias("anchor"), "item", "len", F.expr(f"q - {first}").alias("at"), "part", F.expr(f"transform(starts, s -> s - {first})").alias("starts"),
    )
    index = stored(index, "anchors")
    return index, is_small(index, limit, ANCHOR_BYTES)


def hits(texts: DataFrame, bench_words: DataFrame, limit: int = ANCHOR_LIMIT) -> DataFrame:
    """(_id, _h, n_hit, item_ids): of each text in which a window occurs."""
    index, few = anchors(texts, bench_words, limit)
    # p: where the anchor stands in the text of n words; base: where the part would begin. Bounds first, words after.
    bounds = "p - at + starts[size(starts) - 1] >= 0 AND p - at + starts[0] + len <= n"
    met = texts.select("_id", "_h", F.size("words").alias("n"), "words", F.posexplode("words").alias("p", "anchor"))
    names = stored(index.select("anchor").distinct(), "anchor_words")
    if is_small(names, WORD_LIMIT, WORD_BYTES):
        met = met.join(F.broadcast(names), "anchor", "left_semi")
    # from here on a row holds the words around its own, not the text
    off = f"greatest(p - {WINDOW - 1}, 0)"
    met = met.select("_id", "_h", "n", "p", "anchor", F.expr(off).alias("off"), F.expr(f"slice(words, {off} + 1, {2 * WINDOW - 1})").alias("words"))
    if few:
        met = met.join(F.broadcast(index), "anchor")
    else:
        met = met.withColumn("salt", F.pmod(F.xxhash64("_id", "p"), F.lit(SALTS)).cast("int"))
        met = met.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["anchor", "salt"])
    met = met.where(bounds).withColumn("base", F.expr("p - at"))
    found = F.expr("filter(starts, s -> base + s >= 0 AND base + s + len <= n AND slice(words, base + s - off + 1, len) = slice(part, s + 1, len))")
    met = met.select("_id", "_h", "item", "base", "len", found.alias("found"))
    covered = F.expr("array_distinct(flatten(transform(found, s -> sequence(base + s, base + s + len - 1))))")
    met = met.select("_id", "_h", F.expr("CASE WHEN size(found) > 0 THEN item END").alias("item"), covered.alias("covered"))
    # a group is one text's own occurrences
    return met.groupBy("_id", "_h").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("item_ids"),
    ).where("n_hit > 0")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\x00")).alias("_id"), F.xxhash64(text).alias("_h"), F.col(f"`{id_col}`").alias("_given"), words(lower_ascii(text), SEPARATORS).alias("words"))


def contaminated() -> str:
    return f"n_hit > 0 AND {RATIO} * n_hit >= n_words"


def measure(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", limit: int = ANCHOR_LIMIT) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    texts = stored(_keyed(docs, id_col, text_col), "words")
    found = hits(texts, _item_words(bench, item_col, text_col), limit)
    out = texts.select("_id", "_h", "_given", F.size("words").cast("long").alias("n_words")).join(found, ["_id", "_h"], "left")
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    out = out.select(
        F.col("_given").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.expr(contaminated()))


def keep_clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    texts = stored(_keyed(docs, id_col, text_col), "words")
    found = hits(texts, _item_words(bench, item_col, text_col))
    sizes = texts.select("_id", "_h", F.size("words").alias("n_words")).distinct()
    bad = found.join(sizes, ["_id", "_h"]).where(contaminated()).select(F.col("_id").alias("_bad_id"), F.col("_h").alias("_bad_h"))
    bad = if_small(stored(bad, "contaminated"))  # few as a rule, and then texts aren't shuffled
    same = (F.coalesce(docs[id_col].cast("string"), F.lit("\x00")) == F.col("_bad_id")) & (F.xxhash64(docs[text_col]) == F.col("_bad_h"))
    return docs.join(bad, same, "left_anti")
