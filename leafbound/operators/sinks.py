"""What leaves the engine: uploads accepted, parts written, exports, deletions."""

from __future__ import annotations

import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafbound.functions.intervals import cover
from leafbound.plans.ops import op, view

op("s4_bytes_source", "Files given whole: how long, and a checksum of each page's text.", "SELECT file_id, page_number, cast(length(text) AS bigint) AS n_chars, md5(text) AS checksum FROM {pages_doc}", per_page=True)
op("s8_upload_sink", "Uploads that are accepted: PDFs of 500 MB at most.", """
SELECT page_id, url, CASE WHEN NOT contains(lower(url), '.') THEN 'no name' WHEN size_mb > 500 THEN 'too large' WHEN suffix <> 'pdf' THEN 'not a PDF' ELSE 'accepted' END AS verdict FROM {uploads}""")
op("s9_split_sink", "The parts of each file with their folders.", "SELECT file_id, name, concat(file_id, '/', name, '.pdf') AS path, page_count FROM {b20_split_naming}")
view("page_previews", "What an export shows of each page.", "SELECT file_id, page_number, left(text, 200) AS preview, word_count, ocr_confidence FROM {pages_seeded}", per_page=True)


def rag_export(found: DataFrame, previews: DataFrame) -> DataFrame:
    """A JSON document for each range, with previews of its pages that have text."""
    shown = cover(previews.where("preview <> ''"), found.select("file_id", "start_page", "end_page", "confidence", "document_type"))
    page = F.struct(F.col("page_number").alias("page"), "preview", "word_count", F.col("ocr_confidence").alias("confidence"))
    docs = shown.groupBy("file_id", "start_page", "end_page", "confidence", "document_type").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.sum(F.length("preview")).alias("preview_chars"), F.sum("word_count").alias("word_count"))
    body = F.struct(F.col("file_id").alias("file"), F.coalesce("document_type", F.lit("unknown")).alias("type"), F.bround("confidence", 6).alias("confidence"), "start_page", "end_page", "pages")
    return docs.select("file_id", "start_page", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"), "preview_chars", "word_count")


def without_files(pages: DataFrame, deleted: list[str]) -> DataFrame:
    """Pages left after files were deleted; those of the null file stay."""
    return pages.where(F.coalesce(~F.col("file_id").isin(deleted), F.lit(True)))


op("s10_rag_export", "A JSON document for each document found, with previews of its pages.", lambda b4_segment_pages, page_previews: rag_export(b4_segment_pages, page_previews))
op("s11_delete", "Pages left after files were deleted.", lambda pages_doc: without_files(pages_doc, ["src1", "src3"]).select("file_id", "page_number"))


def cached(df: DataFrame) -> DataFrame:
    """A result kept on the executors' disks, two copies, for as long as it is needed."""
    return df.persist(StorageLevel.DISK_ONLY_2)


def write_parts(pages: DataFrame, parts: DataFrame, path: str) -> str:
    """pages (file_id, page_number, ...) by part, one folder for each file and part, as one new version of `path`. parts: (file_id, start_page, end_page).

    Tasks write under the version's own folder, and Spark's committer keeps what one attempt of each task wrote. Only when all is
    written and counted does the version's manifest appear, by one rename; `read_parts` reads what the newest manifest names. So
    failed or half-done runs are never seen, and readers of an earlier version aren't disturbed. Returns the version.
    """
    spark, version = pages.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    target = f"{path}/data/{version}"
    split = cover(pages, parts.select("file_id", "start_page", "end_page"))
    split.write.partitionBy("file_id", "start_page").parquet(target)
    listed = spark.read.schema(split.schema).parquet(target).groupBy("file_id", "start_page").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("n_pages"))
    listed.withColumn("version", F.lit(version)).coalesce(1).write.parquet(f"{path}/data/{version}-manifest")
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(there)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{version}-manifest"), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{version}")):
        raise OSError(f"the manifest of {version} can't be put in place")
    return version


def manifest(spark: SparkSession, path: str) -> tuple[str, DataFrame] | None:
    """The newest version and its parts: (file_id, start_page, first_page, last_page, n_pages)."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    versions = sorted(f.getPath().getName() for f in fs.listStatus(there)) if fs.exists(there) else []
    return (versions[-1], spark.read.parquet(f"{path}/manifests/{versions[-1]}")) if versions else None


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the newest version that was committed."""
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no committed parts in {path}")
    return spark.read.parquet(f"{path}/data/{found[0]}")
