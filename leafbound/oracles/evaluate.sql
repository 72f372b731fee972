-- a1_detection_summary
SELECT method, coalesce(kind, 'unknown') AS document_type, count(*) AS n, round_even(avg(confidence), 6) AS mean_confidence, count_if(confidence >= 0.8::double) AS high, count_if(confidence < 0.6::double) AS low FROM {fused} WHERE confidence IS NOT NULL GROUP BY method, coalesce(kind, 'unknown')

-- a2_confidence_distribution
SELECT file_id, count_if(confidence >= 0.8::double) AS high, count_if(confidence >= 0.6::double AND confidence < 0.8::double) AS medium, count_if(confidence < 0.6::double) AS low FROM {b4_segment_pages} GROUP BY file_id

-- a3_type_histogram
SELECT document_type, count(*) AS n FROM {b4_segment_pages} WHERE document_type IS NOT NULL GROUP BY document_type

-- by_preset
SELECT 'construction' AS preset, file_id, page_number, confidence FROM {b2_rule_confidence} WHERE confidence >= 0.6::double AND n_signals >= 1 UNION ALL SELECT 'general' AS preset, file_id, page_number, confidence FROM {b2_rule_confidence} WHERE confidence >= 0.6::double AND n_signals >= 1 UNION ALL SELECT 'high_accuracy' AS preset, file_id, page_number, confidence FROM {b2_rule_confidence} WHERE confidence >= 0.7::double AND n_signals >= 2 UNION ALL SELECT 'fast' AS preset, file_id, page_number, confidence FROM {b2_rule_confidence} WHERE confidence >= 0.5::double AND n_signals >= 1

-- a4_compare_methods
SELECT preset, file_id, count(*) + 1 AS n_ranges, round_even(avg(confidence), 6) AS mean_confidence FROM {by_preset} GROUP BY preset, file_id

-- a5_batch_analyze
SELECT p.file_id, p.pages, coalesce(b.n, 0) AS n_ranges, b.mean_confidence, CASE WHEN b.n IS NULL THEN 'error' ELSE 'ok' END AS status FROM (SELECT file_id, count(*) AS pages FROM {pages_seeded} GROUP BY file_id) p LEFT JOIN (SELECT file_id, count(*) AS n, round_even(avg(confidence), 6) AS mean_confidence FROM {b4_segment_pages} GROUP BY file_id) b ON p.file_id IS NOT DISTINCT FROM b.file_id

-- judged
SELECT coalesce(d.file_id, t.file_id) AS file_id, coalesce(d.start_page, t.start_page) AS page_number, d.start_page IS NOT NULL AS found, t.start_page IS NOT NULL AS expected, t.kind, d.document_type FROM {b4_segment_pages} d FULL OUTER JOIN {truth} t ON d.file_id IS NOT DISTINCT FROM t.file_id AND d.start_page = t.start_page

-- a6_eval_position
SELECT file_id, tp, fp, fn, round_even(CASE WHEN tp + fp = 0 THEN 0::double ELSE tp / cast(tp + fp AS double) END, 9) AS precision_, round_even(CASE WHEN tp + fn = 0 THEN 0::double ELSE tp / cast(tp + fn AS double) END, 9) AS recall_, round_even(CASE WHEN tp = 0 THEN 0::double ELSE 2 * (tp / cast(tp + fp AS double)) * (tp / cast(tp + fn AS double)) / (tp / cast(tp + fp AS double) + tp / cast(tp + fn AS double)) END, 9) AS f1, missed, extra FROM (SELECT file_id, count_if(found AND expected) AS tp, count_if(found AND NOT expected) AS fp, count_if(expected AND NOT found) AS fn,
  array_to_string(list_transform(list_sort(list_filter(list(CASE WHEN expected AND NOT found THEN page_number END), lambda x: x IS NOT NULL)), lambda x: cast(x AS string)), ',') AS missed, array_to_string(list_transform(list_sort(list_filter(list(CASE WHEN found AND NOT expected THEN page_number END), lambda x: x IS NOT NULL)), lambda x: cast(x AS string)), ',') AS extra
FROM {judged} WHERE page_number > 1 GROUP BY file_id)

-- a7_eval_overlap
SELECT d.file_id, d.start_page, d.end_page, t.start_page AS true_start, t.end_page AS true_end, (d.start_page = t.start_page AND d.end_page = t.end_page) AS exact
FROM {b11_hybrid_fuse} d JOIN {truth} t ON d.file_id IS NOT DISTINCT FROM t.file_id AND d.start_page <= t.end_page AND t.start_page <= d.end_page
WHERE (least(d.end_page, t.end_page) - greatest(d.start_page, t.start_page) + 1) / cast(greatest(d.end_page, t.end_page) - least(d.start_page, t.start_page) + 1 AS double) > 0.5::double

-- a8_eval_by_type
SELECT kind, count(*) AS expected, count_if(found) AS found, round_even(count_if(found) / cast(count(*) AS double), 9) AS recall_ FROM {judged} WHERE expected AND page_number > 1 GROUP BY kind

-- a9_signal_effectiveness
SELECT s.signal, count(*) AS total, count_if(t.start_page IS NOT NULL) AS correct FROM {b1_collect_signals} s JOIN {b4_segment_pages} b ON s.file_id IS NOT DISTINCT FROM b.file_id AND s.page_number = b.start_page LEFT JOIN {truth} t ON s.file_id IS NOT DISTINCT FROM t.file_id AND s.page_number = t.start_page GROUP BY s.signal

-- a10_type_confusion
SELECT kind, document_type, count(*) AS n, (document_type = CASE kind WHEN 'Email' THEN 'email' WHEN 'Invoice' THEN 'invoice' ELSE 'report' END) AS accepted FROM {judged} WHERE found AND expected AND document_type IS NOT NULL GROUP BY kind, document_type

-- a11_eval_incl_first
SELECT file_id, tp, fp, fn, round_even(CASE WHEN tp + fp = 0 THEN 0::double ELSE tp / cast(tp + fp AS double) END, 9) AS precision_, round_even(CASE WHEN tp + fn = 0 THEN 0::double ELSE tp / cast(tp + fn AS double) END, 9) AS recall_, round_even(CASE WHEN tp = 0 THEN 0::double ELSE 2 * (tp / cast(tp + fp AS double)) * (tp / cast(tp + fn AS double)) / (tp / cast(tp + fp AS double) + tp / cast(tp + fn AS double)) END, 9) AS f1 FROM (SELECT file_id, count_if(found AND expected) AS tp, count_if(found AND NOT expected) AS fp, count_if(expected AND NOT found) AS fn FROM {judged} GROUP BY file_id)

-- explain_boundary
SELECT file_id, page_number, concat('Page ', cast(page_number AS string), ' starts a document: ', array_to_string(list_sort(list(signal)), ', ')) AS explanation FROM {b1_collect_signals} GROUP BY file_id, page_number

-- a7_overlap_scores
SELECT file_id, exact, tp - exact AS partial, tp, n_found - tp AS fp, n_true - tp AS fn, round_even(CASE WHEN n_found = 0 THEN 0::double ELSE tp / n_found::double END, 9) AS precision_, round_even(CASE WHEN n_true = 0 THEN 0::double ELSE tp / n_true::double END, 9) AS recall_,
  round_even(CASE WHEN tp = 0 THEN 0::double ELSE 2 * (tp / n_found::double) * (tp / n_true::double) / (tp / n_found::double + tp / n_true::double) END, 9) AS f1
FROM (SELECT f.file_id, coalesce(d.n, 0) AS n_found, coalesce(t.n, 0) AS n_true, coalesce(m.n, 0) AS tp, coalesce(m.exact, 0) AS exact FROM (SELECT DISTINCT file_id FROM {pages_doc}) f
  LEFT JOIN (SELECT file_id, count(*) AS n FROM {b11_hybrid_fuse} GROUP BY file_id) d ON d.file_id IS NOT DISTINCT FROM f.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM {truth} GROUP BY file_id) t ON t.file_id IS NOT DISTINCT FROM f.file_id
  LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (exact) AS exact FROM {a7_eval_overlap} GROUP BY file_id) m ON m.file_id IS NOT DISTINCT FROM f.file_id)

-- a1_signal_histogram
SELECT plugin, signal, count(*) AS n, count(DISTINCT file_id || '#' || page_number) AS pages, round_even(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.6) AS low FROM {b6_plugin_group} GROUP BY plugin, signal

