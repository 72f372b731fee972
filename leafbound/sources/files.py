"""Text files as page streams: whole bytes with checksums, pages parted by form feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as they are: file_id (the path), content, n_bytes, md5, sha256, modified. Filters on length and time reach the scan. Spark's file scan passes over files of no bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("path").alias("file_id"), "content", F.col("length").alias("n_bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def pages_of(files: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """files: (file_id, content), of UTF-8. One row a page: file_id, page_number, text, word_count, has_tables, blank.

    Only pages from first to last are made rows of; a last page beyond the end is the end. An empty file has one blank page;
    a null one has none.
    """
    whole = F.split(F.decode("content", "UTF-8"), "\f")
    some = F.slice(whole, F.lit(first), F.least(F.size(whole), F.lit(last if last is not None else 2**31 - 1)) - first + 1)
    rows = files.where(F.size(whole) >= first).select("file_id", F.posexplode(some).alias("_n", "text"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), F.lit(0)))
    tables = F.exists(F.split("text", "\n"), lambda line: F.contains(line, F.lit("\t")) | F.contains(line, F.lit("  ")))
    return rows.select("file_id", (F.col("_n") + first).cast("int").alias("page_number"), "text", words.alias("word_count"), tables.alias("has_tables"), (words == 0).alias("blank"))


def whole_texts(pages: DataFrame) -> DataFrame:
    """Each file's converted text: its pages in order, parted by form feeds. A file must fit into a task's memory, as text of one row."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\f").alias("text"), F.count("*").alias("n_pages"), F.sum("word_count").alias("n_words"))
