"""From signals to page ranges: the rule detector."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.windows import ranges
from leafbound.plans.ops import op, view

# Confidence weights of the rule signals, in the order in which they are collected.
WEIGHTS = {"email_header": "0.9", "document_header": "0.85", "page_number_reset": "0.7", "layout_change": "0.6", "white_space": "0.5", "document_type_change": "0.8"}
COLS = {"email_header": "c1", "document_header": "c2", "page_number_reset": "c3", "layout_change": "c4", "white_space": "c5", "document_type_change": "c6"}
view("rule_signals", "Confidences of the six rule signals, null where a signal is silent; first pages have none.", """
SELECT file_id, page_number, kind, is_last, CASE WHEN page_number > 1 AND email >= 2 THEN least(0.9D, 0.3D * email) END AS c1, CASE WHEN page_number > 1 AND heading IS NOT NULL THEN 0.85D END AS c2, CASE WHEN page_number > 1 THEN reset END AS c3,
  CASE WHEN page_number > 1 AND abs(density - before1.density) / greatest(before1.density, density, 0.001D) > 0.5D THEN 0.6D END AS c4, CASE WHEN page_number > 1 AND word_count < 50 THEN least(0.8D, 0.5D + 0.3D * (1 - word_count / 50D)) END AS c5,
  CASE WHEN page_number > 1 AND kind <> before1.kind THEN 0.8D END AS c6,
  CASE WHEN before1.family IS NULL OR before1.family <> family THEN family END AS family_begins
FROM {page_pairs}
""")
_n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in COLS.values())
_num = " + ".join(f"coalesce({COLS[t]} * {w}D, 0D)" for t, w in WEIGHTS.items())
_den = " + ".join(f"CASE WHEN {COLS[t]} IS NULL THEN 0D ELSE {w}D END" for t, w in WEIGHTS.items())
_strong = " + ".join(f"CASE WHEN {c} >= 0.7D THEN 1 ELSE 0 END" for c in COLS.values())
_which = "CASE signal " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in COLS.items()) + " END"
op("b1_collect_signals", "One row for each signal, in the detector's order.", f"""
SELECT file_id, page_number, signal, confidence FROM (SELECT file_id, page_number, signal, {_which} AS confidence FROM (SELECT s.*, explode(array({", ".join(f"'{t}'" for t in COLS)})) AS signal FROM {{rule_signals}} s)) WHERE confidence IS NOT NULL""")
view("rule_pages", "Every page with its rule confidence: the weighted mean of its signals, raised if two are strong; whether it starts a document.", f"""
SELECT *, page_number = 1 OR (confidence >= 0.6D AND n_signals >= 1) AS starts FROM (SELECT *, CASE WHEN n_signals = 0 THEN 0D WHEN strong >= 2 THEN least(1D, num / den * 1.2D) ELSE num / den END AS confidence
FROM (SELECT *, {_n} AS n_signals, {_num} AS num, {_den} AS den, {_strong} AS strong FROM {{rule_signals}}))""")
op("b2_rule_confidence", "Weighted mean of a page's signals, raised if two are strong.", "SELECT file_id, page_number, kind, n_signals, confidence FROM {rule_pages} WHERE page_number > 1")
op("b3_threshold", "Candidates that are sure enough.", "SELECT file_id, page_number, kind, n_signals, confidence FROM {rule_pages} WHERE page_number > 1 AND starts")


def closed(pages: DataFrame) -> DataFrame:
    """Ranges of pages (file_id, page_number, is_last, starts, confidence, kind): each ends before the next starts, the last at its file's last page."""
    return ranges(pages.select("file_id", "page_number", "is_last", "starts", "confidence", "kind"), "starts", "is_last").select("file_id", "start_page", "end_page", "confidence", F.col("kind").alias("document_type"))


def segment(rule_pages: DataFrame) -> DataFrame:
    return closed(rule_pages.withColumn("confidence", F.when(F.col("page_number") == 1, F.lit(1.0)).otherwise(F.col("confidence"))))


def refine(rule_pages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Ranges after review. feedback: (file_id, page_number, is_boundary); one refusal of several verdicts on a page is enough."""
    said = feedback.where("page_number IS NOT NULL").groupBy(F.col("file_id").alias("_file"), F.col("page_number").alias("_page")).agg(F.bool_or(~F.col("is_boundary")).alias("refused"), F.bool_or("is_boundary").alias("asserted"))
    both = rule_pages.join(said, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("page_number") == F.col("_page")), "left")
    kept, asserted = F.col("starts") & ~F.coalesce("refused", F.lit(False)), F.coalesce("asserted", F.lit(False)) & ~F.col("starts")
    sure = F.when((F.col("page_number") == 1) | asserted, F.lit(1.0)).otherwise(F.col("confidence"))
    return closed(both.withColumn("confidence", sure).withColumn("starts", kept | asserted))


op("b4_segment_pages", "Page ranges of the documents in each file.", segment)
op("b5_refine_feedback", "Ranges after review: refused starts gone, asserted ones in, ends anew.", refine)
