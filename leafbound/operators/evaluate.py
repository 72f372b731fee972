"""Reports over ranges, and how they compare with ground truth."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.intervals import overlap
from leafbound.operators.planning import PRESETS
from leafbound.plans.ops import op, view

_f1 = "CASE WHEN tp = 0 THEN 0D ELSE 2 * (tp / cast(tp + fp AS double)) * (tp / cast(tp + fn AS double)) / (tp / cast(tp + fp AS double) + tp / cast(tp + fn AS double)) END"
_SCORES = {"precision_": "CASE WHEN tp + fp = 0 THEN 0D ELSE tp / cast(tp + fp AS double) END", "recall_": "CASE WHEN tp + fn = 0 THEN 0D ELSE tp / cast(tp + fn AS double) END", "f1": _f1}
_prf_list = ["tp", "fp", "fn", *[f"bround({e}, 9) AS {n}" for n, e in _SCORES.items()]]
_prf = ", ".join(_prf_list)
op("a1_detection_summary", "Ranges by method and type, with confidence bands.", "SELECT method, coalesce(kind, 'unknown') AS document_type, count(*) AS n, bround(avg(confidence), 6) AS mean_confidence, count_if(confidence >= 0.8D) AS high, count_if(confidence < 0.6D) AS low FROM {fused} WHERE confidence IS NOT NULL GROUP BY method, coalesce(kind, 'unknown')")
op("a2_confidence_distribution", "Ranges by confidence band.", "SELECT file_id, count_if(confidence >= 0.8D) AS high, count_if(confidence >= 0.6D AND confidence < 0.8D) AS medium, count_if(confidence < 0.6D) AS low FROM {b4_segment_pages} GROUP BY file_id")
op("a3_type_histogram", "Ranges by type.", "SELECT document_type, count(*) AS n FROM {b4_segment_pages} WHERE document_type IS NOT NULL GROUP BY document_type")
view("by_preset", "Boundaries as each preset would have them: their least confidence and signals act.", " UNION ALL ".join(f"SELECT '{p[0]}' AS preset, file_id, page_number, confidence FROM {{b2_rule_confidence}} WHERE confidence >= {p[5]}D AND n_signals >= {p[6]}" for p in PRESETS if p[2] != "0.0"))
op("a4_compare_methods", "How many ranges each preset finds, and how sure.", "SELECT preset, file_id, count(*) + 1 AS n_ranges, bround(avg(confidence), 6) AS mean_confidence FROM {by_preset} GROUP BY preset, file_id")
op("a5_batch_analyze", "Every file at once: pages, ranges, confidence; files without pages don't hold up others.", "SELECT p.file_id, p.pages, coalesce(b.n, 0) AS n_ranges, b.mean_confidence, CASE WHEN b.n IS NULL THEN 'error' ELSE 'ok' END AS status FROM (SELECT file_id, count(*) AS pages FROM {pages_seeded} GROUP BY file_id) p LEFT JOIN (SELECT file_id, count(*) AS n, bround(avg(confidence), 6) AS mean_confidence FROM {b4_segment_pages} GROUP BY file_id) b ON p.file_id IS NOT DISTINCT FROM b.file_id")
view("judged", "Starts found against starts expected.", "SELECT coalesce(d.file_id, t.file_id) AS file_id, coalesce(d.start_page, t.start_page) AS page_number, d.start_page IS NOT NULL AS found, t.start_page IS NOT NULL AS expected, t.kind, d.document_type FROM {b4_segment_pages} d FULL OUTER JOIN {truth} t ON d.file_id IS NOT DISTINCT FROM t.file_id AND d.start_page = t.start_page")
op("a6_eval_position", "Precision, recall and F1 of the starts after page 1, pages missed and too many.", f"""
SELECT file_id, {_prf}, missed, extra FROM (SELECT file_id, count_if(found AND expected) AS tp, count_if(found AND NOT expected) AS fp, count_if(expected AND NOT found) AS fn,
  array_join(transform(array_sort(filter(collect_list(CASE WHEN expected AND NOT found THEN page_number END), x -> x IS NOT NULL)), x -> cast(x AS string)), ',') AS missed, array_join(transform(array_sort(filter(collect_list(CASE WHEN found AND NOT expected THEN page_number END), x -> x IS NOT NULL)), x -> cast(x AS string)), ',') AS extra
FROM {{judged}} WHERE page_number > 1 GROUP BY file_id)""")


def overlapping(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of a found and a true range that share over half of what both span: one at most for each, so the order of matching doesn't matter."""
    true = truth.select("file_id", F.col("start_page").alias("true_start"), F.col("end_page").alias("true_end"))
    pairs = overlap(found.select("file_id", "start_page", "end_page"), true, ("start_page", "end_page"), ("true_start", "true_end"))
    shared = F.least("end_page", "true_end") - F.greatest("start_page", "true_start") + 1
    spanned = F.greatest("end_page", "true_end") - F.least("start_page", "true_start") + 1
    return pairs.where(shared / spanned.cast("double") > 0.5).withColumn("exact", (F.col("start_page") == F.col("true_start")) & (F.col("end_page") == F.col("true_end")))


def overlap_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per file: pairs that match, exactly and in part, ranges found and expected without one, precision, recall and F1."""
    count = lambda df, c: df.groupBy("file_id").agg(F.count("*").alias(c))
    pairs = overlapping(found, truth).groupBy("file_id").agg(F.count("*").alias("tp"), F.count_if("exact").alias("exact"))
    out = count(found, "n_found")
    for other in (count(truth, "n_true"), pairs):
        other = other.withColumnRenamed("file_id", "_file")
        out = out.join(other, F.col("file_id").eqNullSafe(F.col("_file")), "full").withColumn("file_id", F.coalesce("file_id", "_file")).drop("_file")
    out = out.na.fill(0, ["n_found", "n_true", "tp", "exact"])
    return out.selectExpr("file_id", "tp", "exact", "tp - exact AS partial", "n_found - tp AS fp", "n_true - tp AS fn").selectExpr("file_id", "exact", "partial", *_prf_list)


op("a7_eval_overlap", "Ranges that share over half of what both span.", lambda b11_hybrid_fuse, truth: overlapping(b11_hybrid_fuse, truth))
op("a7_overlap_scores", "Matches by overlap: true, false and missing ranges, precision, recall and F1 of each file.", lambda b11_hybrid_fuse, truth: overlap_scores(b11_hybrid_fuse, truth))
op("a1_signal_histogram", "How often each signal is given, by whom and how sure, and on how many pages.", "SELECT plugin, signal, count(*) AS n, count(DISTINCT file_id, page_number) AS pages, bround(avg(confidence), 6) AS mean_confidence, count_if(confidence >= 0.8D) AS high, count_if(confidence < 0.6D) AS low FROM {b6_plugin_group} GROUP BY plugin, signal")
op("a8_eval_by_type", "Recall by expected type, first pages aside.", "SELECT kind, count(*) AS expected, count_if(found) AS found, bround(count_if(found) / cast(count(*) AS double), 9) AS recall_ FROM {judged} WHERE expected AND page_number > 1 GROUP BY kind")
op("a9_signal_effectiveness", "How often a signal's pages are right.", "SELECT s.signal, count(*) AS total, count_if(t.start_page IS NOT NULL) AS correct FROM {b1_collect_signals} s JOIN {b4_segment_pages} b ON s.file_id IS NOT DISTINCT FROM b.file_id AND s.page_number = b.start_page LEFT JOIN {truth} t ON s.file_id IS NOT DISTINCT FROM t.file_id AND s.page_number = t.start_page GROUP BY s.signal")
op("a10_type_confusion", "Expected types against found ones, with what counts as right.", """
SELECT kind, document_type, count(*) AS n, (document_type = CASE kind WHEN 'Email' THEN 'email' WHEN 'Invoice' THEN 'invoice' ELSE 'report' END) AS accepted FROM {judged} WHERE found AND expected AND document_type IS NOT NULL GROUP BY kind, document_type""")
op("a11_eval_incl_first", "Precision, recall and F1 with page 1.", f"SELECT file_id, {_prf} FROM (SELECT file_id, count_if(found AND expected) AS tp, count_if(found AND NOT expected) AS fp, count_if(expected AND NOT found) AS fn FROM {{judged}} GROUP BY file_id)")
op("explain_boundary", "A sentence on why a page starts a document.", """
SELECT file_id, page_number, concat('Page ', cast(page_number AS string), ' starts a document: ', array_join(array_sort(collect_list(signal)), ', ')) AS explanation FROM {b1_collect_signals} GROUP BY file_id, page_number""")
