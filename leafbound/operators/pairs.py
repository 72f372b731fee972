"""Detectors over a page and its neighbours."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafbound.functions.windows import BLOCK, beside
from leafbound.plans.ops import op, view

view("page_pairs", "What the detectors go by, with that of the page before; whether a file ends here.", lambda page_facts: _pairs(page_facts))


def _pairs(page_facts: DataFrame) -> DataFrame:
    return beside(page_facts, ["kind", "density", "family", "n_chars"], back=1, ahead=1).withColumn("is_last", F.col("after1").isNull()).drop("after1")


def short_files(df: DataFrame, most: int) -> DataFrame:
    """df with `short`: whether the file has `most` pages at most. Only the first pages of a file meet in a task."""
    first = F.when(F.col("page_number") <= most + 1, F.lit(None)).otherwise(F.floor(F.col("page_number") / BLOCK))
    by = F.max("page_number").over(Window.partitionBy("file_id", first))
    return df.withColumn("short", (F.col("page_number") <= most) & (by <= most))


op("w1_layout_change", "Word density unlike the page before.", """
SELECT file_id, page_number, CASE WHEN before1 IS NOT NULL AND abs(density - before1.density) / greatest(before1.density, density, 0.001D) > 0.5D THEN 0.6D END AS confidence FROM {page_pairs}
""")
op("w2_type_change", "A type unlike the page before's.", "SELECT file_id, page_number, CASE WHEN kind <> before1.kind THEN 0.8D END AS confidence FROM {page_pairs}")
op("w3_construction_boundary", "A family of construction papers begins.", "SELECT file_id, page_number, family, (family IS NOT NULL AND (before1.family IS NULL OR before1.family <> family)) AS starts FROM {page_pairs}")
VISUAL_CHANGE = """least(1D, CASE WHEN size(filter(layout_types, x -> NOT array_contains(p.layout_types, x))) + size(filter(p.layout_types, x -> NOT array_contains(layout_types, x))) > 2 THEN 0.3D ELSE 0D END
    + CASE WHEN p.word_count > 0 AND abs(word_count - p.word_count) / cast(p.word_count AS double) > 0.5D THEN 0.2D ELSE 0D END + CASE WHEN (num_tables > 0) <> (p.num_tables > 0) THEN 0.2D ELSE 0D END
    + CASE WHEN (num_images > 0) <> (p.num_images > 0) THEN 0.2D ELSE 0D END + CASE WHEN abs(aspect - p.aspect) > 0.1D THEN 0.1D ELSE 0D END)"""
op("w4_visual_change", "How far layout, words, tables, images and aspect are from the page before's.", f"""
SELECT file_id, page_number, score, (score > 0.6D) AS starts FROM (SELECT file_id, page_number, {VISUAL_CHANGE.replace("p.", "before1.")} AS score FROM {{visual_beside}} WHERE before1.word_count IS NOT NULL)
""")
op("w5_text_length_change", "From much text to little, or back.", "SELECT file_id, page_number, coalesce((before1.n_chars > 100 AND n_chars < 50) OR (before1.n_chars < 50 AND n_chars > 100), false) AS changes FROM {page_pairs}")


def page_context(pages: DataFrame, methods: tuple[str, ...] | None = None) -> DataFrame:
    """Pages with their neighbours' texts. With methods, only those pages have them whose column `method` is among these."""
    out = beside(pages, ["text"], back=1, ahead=1)
    shown = F.lit(True) if methods is None else F.coalesce(F.col("method").isin(*methods), F.lit(False))
    return out.withColumns({"previous_text": F.when(shown, F.col("before1.text")), "next_text": F.when(shown, F.col("after1.text"))}).drop("before1", "after1")


op("w6_page_context", "Turns of a conversation with their neighbours.", lambda conversations: page_context(
    conversations.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("bigint").alias("page_number"), "text")).select("file_id", "page_number", "text", "previous_text", "next_text", F.lit(0.0).alias("confidence")))


def _near(pages: DataFrame, said: str, reach: int) -> DataFrame:
    return beside(pages, [said], back=reach, ahead=reach)


def near(said: str, reach: int) -> Column:
    """Whether `said` holds on a page or within `reach` pages of it."""
    return F.coalesce(F.greatest(F.col(said), *[F.col(f"{side}{k}.{said}") for side in ("before", "after") for k in range(1, reach + 1)]), F.lit(False))


def _near_boundary(page_facts: DataFrame) -> DataFrame:
    pages = page_facts.select("file_id", "page_number", ((F.col("page_number") == 1) | F.col("indicated")).alias("p"))
    pages = short_files(_near(pages, "p", 2), 10)
    return pages.select("file_id", "page_number", (F.col("short") | near("p", 1)).alias("high_quality"), (F.col("short") | near("p", 2) | (F.col("page_number") % 5 == 0)).alias("llm"))


op("w7_near_boundary", "Which pages a model or good OCR should see: near potential starts, every fifth, all of short files.", _near_boundary)
op("w8_context_pages", "Pages within two of a potential start.", lambda t8_potential_boundary: _near(t8_potential_boundary, "potential", 2).select("file_id", "page_number", near("potential", 2).alias("medium")))
