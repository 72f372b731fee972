"""Documents as pages of files: the documents of a source in order of id are the pages of one file.

A page's number is where it stands in its file. Numbers are given late: operators that look at one page at a time run over
`page_rows`, where `page_number` is a place (the id, and a hash of the row that tells rows of one id apart), and
`numbered` deals out what they give by file and block of ids. Texts stay where they were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a block, within which pages are numbered at once.
BLOCK = 256


def page_rows(documents: DataFrame) -> DataFrame:
    """One row a document, keyed by file_id and its place."""
    text, place = F.coalesce("text", F.lit("")), F.struct("doc_id", F.xxhash64("text", "lang").alias("tie"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), F.lit(0)))
    rows = documents.select(F.col("source").alias("file_id"), place.alias("page_number"), "doc_id", text.alias("text"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), "lang")
    return rows.withColumn("word_count", words.cast("int"))


def _keys(file: str, doc: str) -> dict:
    """File and block as columns that are never null."""
    return {"_f": F.coalesce(F.col(file).cast("string"), F.lit("")), "_none": F.col(file).isNull(), "_b": F.coalesce(F.floor(F.col(doc) / F.lit(float(BLOCK))).cast("bigint"), F.lit(-(2**62)))}


def numbered(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (one for each document, with its place as page_number) with page numbers from 1 in each file.

    The pages before each block are counted over ids alone; equal rows of one id stand in any order, as nothing tells them apart.
    """
    keys = ["_f", "_none", "_b"]
    blocks = documents.select("source", "doc_id").withColumns(_keys("source", "doc_id")).groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_f", "_none").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.withColumns(_keys("file_id", "page_number.doc_id")).join(blocks, keys)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("page_number"))
    return placed.withColumn("page_number", (F.col("_before") + at).cast("int")).drop(*keys, "_before")
