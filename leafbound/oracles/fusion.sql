-- b6_plugin_group
SELECT file_id, page_number, 'rule' AS plugin, signal, confidence FROM {b1_collect_signals}
UNION ALL SELECT file_id, page_number, 'construction' AS plugin, 'construction_specific' AS signal, CASE family WHEN 'rfi' THEN 0.9::double WHEN 'submittal' THEN 0.85::double WHEN 'change_order' THEN 0.9::double WHEN 'daily_report' THEN 0.8::double WHEN 'safety_document' THEN 0.85::double WHEN 'meeting_minutes' THEN 0.8::double END AS confidence FROM {w3_construction_boundary} WHERE starts
UNION ALL SELECT file_id, page_number, 'vlm' AS plugin, 'vlm_visual' AS signal, score AS confidence FROM {w4_visual_change} WHERE starts

-- b7_plugin_confidence
SELECT file_id, page_number, n_signals, n_types, round_even(least(1::double, v * CASE WHEN n_types >= 3 THEN 1.2::double WHEN n_types = 2 THEN 1.1::double ELSE 1::double END), 9) AS confidence
FROM (SELECT file_id, page_number, cast(sum(n) AS bigint) AS n_signals, count(*) AS n_types, sum(c * w) / sum(w) AS v FROM (SELECT file_id, page_number, signal, count(*) AS n, avg(confidence) AS c, CASE signal WHEN 'document_header' THEN 0.85::double WHEN 'email_header' THEN 0.9::double WHEN 'page_number_reset' THEN 0.7::double WHEN 'layout_change' THEN 0.6::double WHEN 'white_space' THEN 0.5::double WHEN 'document_type_change' THEN 0.8::double WHEN 'llm_semantic' THEN 0.8::double WHEN 'vlm_visual' THEN 0.7::double WHEN 'construction_specific' THEN 1.2::double ELSE 0.5::double END AS w FROM {b6_plugin_group} GROUP BY file_id, page_number, signal) GROUP BY file_id, page_number)

-- b8_type_vote
SELECT file_id, page_number, document_type FROM (SELECT file_id, page_number, document_type, row_number() OVER (PARTITION BY file_id, page_number ORDER BY sum(v) DESC, min(o), document_type) AS r
FROM (SELECT r.file_id, r.page_number, r.kind AS document_type, r.confidence AS v, 1 AS o FROM {b2_rule_confidence} r WHERE r.n_signals > 0
  UNION ALL SELECT file_id, page_number, 'report' AS document_type, confidence AS v, 2 AS o FROM {b6_plugin_group} WHERE plugin = 'construction' UNION ALL SELECT file_id, page_number, coalesce(CASE WHEN text = '' THEN NULL WHEN (cast(regexp_matches(h500, '(?im)^From:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^To:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Subject:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Date:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Sent:\s*(.+)$') AS int)) >= 2 THEN 'email' WHEN (contains(l1000, 'invoice') OR contains(l1000, 'bill to') OR contains(l1000, 'ship to') OR contains(l1000, 'total amount')) THEN 'invoice'
  WHEN (contains(l1000, 'purchase order') OR contains(l1000, 'p.o.') OR contains(l1000, 'po number')) THEN 'invoice' WHEN (contains(l1000, 'quotation') OR contains(l1000, 'quote') OR contains(l1000, 'estimate')) THEN 'other'
  WHEN contains(l1000, 'contract') AND contains(l1000, 'agreement') THEN 'contract'
  WHEN (contains(l1000, 'request for information') OR contains(l1000, 'rfi') OR contains(l1000, 'submittal') OR contains(l1000, 'proposal') OR contains(l1000, 'cost proposal') OR contains(l1000, 'schedule of values')) THEN 'report' WHEN contains(l1000, 'application for payment') THEN 'form'
  WHEN (contains(l1000, 'executive summary') OR contains(l1000, 'table of contents') OR contains(l1000, 'introduction') OR contains(l1000, 'conclusion')) THEN 'report' WHEN (contains(l1000, 'dear') OR contains(l1000, 'sincerely') OR contains(l1000, 'regards') OR contains(l1000, 'yours truly')) THEN 'letter' ELSE 'other' END, 'other') AS document_type, 1::double AS v, 0 AS o FROM {page_heads} WHERE page_number = 1) WHERE document_type IS NOT NULL GROUP BY file_id, page_number, document_type) WHERE r = 1

-- b9_plugin_segment
SELECT s.file_id, s.page_number AS start_page, coalesce(lead(s.page_number) OVER (PARTITION BY s.file_id ORDER BY s.page_number) - 1, l.last_page) AS end_page, s.confidence, s.kind AS document_type
FROM (SELECT file_id, page_number, 1::double AS confidence, kind FROM {rule_features} WHERE page_number = 1 UNION ALL SELECT c.file_id, c.page_number, c.confidence, v.document_type AS kind FROM {b7_plugin_confidence} c LEFT JOIN {b8_type_vote} v ON c.file_id IS NOT DISTINCT FROM v.file_id AND c.page_number = v.page_number WHERE c.page_number > 1 AND c.confidence >= 0.6::double AND c.n_signals >= 1) s JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_seeded} GROUP BY file_id) l ON s.file_id IS NOT DISTINCT FROM l.file_id

-- visual_signals
SELECT file_id, page_number, 'layout_structure' AS signal, confidence FROM {w9_layout_structure} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'font_style' AS signal, confidence FROM {w10_font_change} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'color_scheme' AS signal, confidence FROM {w11_color_change} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'header_footer' AS signal, confidence FROM {w13_header_footer_change} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'separator_line' AS signal, confidence FROM {w14_visual_separator} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'logo' AS signal, confidence FROM {w15_logo} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'signature' AS signal, confidence FROM {w16_signature} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'page_orientation' AS signal, confidence FROM {w17_orientation} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'column_layout' AS signal, confidence FROM {w18_column_change} WHERE confidence IS NOT NULL AND page_number > 1 UNION ALL SELECT file_id, page_number, 'whitespace_pattern' AS signal, confidence FROM {w19_whitespace_pattern} WHERE confidence IS NOT NULL AND page_number > 1

-- b10_visual_confidence
SELECT file_id, page_number, n_signals, round_even(CASE WHEN strong >= 2 THEN least(1::double, v * 1.15::double) ELSE v END, 9) AS confidence
FROM (SELECT file_id, page_number, count(*) AS n_signals, count_if(confidence >= 0.7::double) AS strong, sum(confidence * w) / sum(w) AS v FROM (SELECT file_id, page_number, confidence, CASE signal WHEN 'layout_structure' THEN 0.8::double WHEN 'font_style' THEN 0.7::double WHEN 'color_scheme' THEN 0.6::double WHEN 'separator_line' THEN 0.9::double WHEN 'header_footer' THEN 0.75::double WHEN 'logo' THEN 0.85::double WHEN 'signature' THEN 0.8::double WHEN 'page_orientation' THEN 0.95::double WHEN 'column_layout' THEN 0.7::double WHEN 'whitespace_pattern' THEN 0.5::double ELSE 0.5::double END AS w FROM {visual_signals}) GROUP BY file_id, page_number)

-- b12_page_type
SELECT file_id, page_number, CASE WHEN num_tables > 2 OR has_signature AND num_tables > 0 THEN 'form' WHEN num_charts > 0 AND num_images > 2 THEN 'presentation' WHEN num_tables > 3 AND num_images = 0 THEN 'spreadsheet'
  WHEN has_signature AND num_columns = 1 THEN 'letter' WHEN num_columns > 1 OR has_header AND has_footer THEN 'report' ELSE 'other' END AS document_type FROM {visual}

-- text_candidates
SELECT file_id, start_page AS page_number, confidence, document_type FROM {b4_segment_pages}

-- fused
SELECT coalesce(t.file_id, v.file_id) AS file_id, coalesce(t.page_number, v.page_number) AS page_number, CASE WHEN t.page_number IS NULL THEN 'visual' WHEN v.page_number IS NULL THEN 'text' ELSE 'both' END AS method,
  CASE WHEN t.page_number IS NULL THEN CASE WHEN v.confidence > 0.7::double THEN v.confidence * 0.8::double END WHEN v.page_number IS NULL THEN t.confidence ELSE least(1::double, (0.6::double * t.confidence + 0.4::double * v.confidence) * 1.1::double) END AS confidence, t.document_type AS kind
FROM {text_candidates} t FULL OUTER JOIN (SELECT file_id, page_number, confidence FROM {b10_visual_confidence} WHERE confidence >= 0.5::double AND n_signals >= 1) v ON t.file_id IS NOT DISTINCT FROM v.file_id AND t.page_number = v.page_number

-- b11_hybrid_fuse
SELECT s.file_id, s.page_number AS start_page, coalesce(lead(s.page_number) OVER (PARTITION BY s.file_id ORDER BY s.page_number) - 1, l.last_page) AS end_page, s.confidence, s.kind AS document_type
FROM (SELECT f.file_id, f.page_number, f.confidence, CASE WHEN f.method = 'visual' THEN p.document_type ELSE f.kind END AS kind FROM {fused} f JOIN {b12_page_type} p ON f.file_id IS NOT DISTINCT FROM p.file_id AND f.page_number = p.page_number WHERE f.confidence >= 0.6::double) s JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_seeded} GROUP BY file_id) l ON s.file_id IS NOT DISTINCT FROM l.file_id

-- b13_range_type
SELECT b.file_id, b.start_page, CASE WHEN bool_or(v.has_logo) AND avg(v.num_tables) > 0.5::double THEN 'invoice' WHEN bool_or(v.has_signature) AND count(*) <= 3 THEN 'letter' WHEN avg(v.num_tables) > 1 THEN 'report' WHEN bool_or(v.num_columns > 1) AND count(*) > 5 THEN 'report' WHEN bool_or(v.has_logo) AND count(*) = 1 THEN 'form' ELSE 'other' END AS document_type
FROM {b11_hybrid_fuse} b JOIN {visual} v ON v.file_id IS NOT DISTINCT FROM b.file_id AND v.page_number BETWEEN b.start_page AND b.end_page GROUP BY b.file_id, b.start_page

-- b14_visual_to_standard
SELECT file_id, page_number, CASE signal WHEN 'layout_structure' THEN 'layout_change' WHEN 'column_layout' THEN 'layout_change' WHEN 'page_orientation' THEN 'layout_change' WHEN 'font_style' THEN 'layout_change' WHEN 'color_scheme' THEN 'layout_change' WHEN 'header_footer' THEN 'layout_change' WHEN 'separator_line' THEN 'visual_separator' WHEN 'whitespace_pattern' THEN 'visual_separator' WHEN 'logo' THEN 'document_header' WHEN 'signature' THEN 'document_header' END AS signal, concat('[Visual] ', signal) AS description, confidence FROM {visual_signals}

-- b15_ambiguous_cases
SELECT a.file_id, a.page_number, a.confidence FROM (SELECT file_id, page_number, n, num / den AS confidence FROM (SELECT file_id, page_number, CASE WHEN c1 IS NULL THEN 0 ELSE 1 END + CASE WHEN c2 IS NULL THEN 0 ELSE 1 END + CASE WHEN c3 IS NULL THEN 0 ELSE 1 END + CASE WHEN c4 IS NULL THEN 0 ELSE 1 END + CASE WHEN c6 IS NULL THEN 0 ELSE 1 END AS n, coalesce(c1 * 0.9::double, 0::double) + coalesce(c2 * 0.85::double, 0::double) + coalesce(c3 * 0.7::double, 0::double) + coalesce(c4 * 0.6::double, 0::double) + coalesce(c6 * 0.8::double, 0::double) AS num, CASE WHEN c1 IS NULL THEN 0::double ELSE 0.9::double END + CASE WHEN c2 IS NULL THEN 0::double ELSE 0.85::double END + CASE WHEN c3 IS NULL THEN 0::double ELSE 0.7::double END + CASE WHEN c4 IS NULL THEN 0::double ELSE 0.6::double END + CASE WHEN c6 IS NULL THEN 0::double ELSE 0.8::double END AS den FROM {rule_signals}) WHERE n > 0) a
WHERE (a.confidence BETWEEN 0.4::double AND 0.75::double OR a.n = 1 AND a.confidence < 0.6::double) AND NOT EXISTS (SELECT 1 FROM {b4_segment_pages} b WHERE b.file_id IS NOT DISTINCT FROM a.file_id AND b.start_page = a.page_number AND b.confidence >= 0.75::double)

-- llm_verdicts
SELECT file_id, page_number, (page_number % 3 <> 0) AS yes, 0.5::double + page_number % 5 / 10::double AS confidence, CASE page_number % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'report' ELSE 'letter' END AS document_type FROM {b15_ambiguous_cases}

-- b16_llm_merge
SELECT s.file_id, s.page_number AS start_page, coalesce(lead(s.page_number) OVER (PARTITION BY s.file_id ORDER BY s.page_number) - 1, l.last_page) AS end_page, s.confidence, s.kind AS document_type
FROM (
SELECT coalesce(b.file_id, l.file_id) AS file_id, coalesce(b.page_number, l.page_number) AS page_number, CASE WHEN l.yes AND l.confidence >= 0.6::double THEN greatest(coalesce(b.confidence, 0::double), l.confidence) ELSE b.confidence END AS confidence, CASE WHEN l.yes AND l.confidence >= 0.6::double THEN l.document_type ELSE b.document_type END AS kind
FROM {text_candidates} b FULL OUTER JOIN {llm_verdicts} l ON b.file_id IS NOT DISTINCT FROM l.file_id AND b.page_number = l.page_number
WHERE (b.page_number IS NOT NULL AND NOT (coalesce(NOT l.yes, false) AND b.confidence < 0.7::double)) OR (b.page_number IS NULL AND l.yes AND l.confidence >= 0.6::double)) s JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_seeded} GROUP BY file_id) l ON s.file_id IS NOT DISTINCT FROM l.file_id

-- b17_method_merge
SELECT coalesce(l.file_id, r.file_id) AS file_id, coalesce(l.start_page, r.start_page) AS start_page, CASE WHEN l.start_page IS NOT NULL THEN l.end_page ELSE r.end_page END AS end_page, CASE WHEN l.start_page IS NOT NULL THEN l.confidence ELSE r.confidence END AS confidence, CASE WHEN l.start_page IS NOT NULL THEN 'llm' ELSE 'rule' END AS method
FROM {b16_llm_merge} l FULL OUTER JOIN {b9_plugin_segment} r ON l.file_id IS NOT DISTINCT FROM r.file_id AND l.start_page = r.start_page

-- b18_merge_close
SELECT file_id, min(start_page) AS start_page, max(end_page) AS end_page, max(confidence) AS confidence, count(*) AS n_merged
FROM (SELECT file_id, start_page, end_page, confidence, sum(starts) OVER (PARTITION BY file_id ORDER BY start_page ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT file_id, start_page, end_page, confidence, CASE WHEN coalesce(start_page - max(end_page) OVER (PARTITION BY file_id ORDER BY start_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2, false) THEN 0 ELSE 1 END AS starts FROM {b4_segment_pages})) GROUP BY file_id, island

-- b19_enhanced_post
SELECT m.file_id, m.start_page, m.end_page, m.confidence FROM {b18_merge_close} m JOIN {t10_type_hints} h ON m.file_id IS NOT DISTINCT FROM h.file_id WHERE h.construction
UNION ALL SELECT b.file_id, b.start_page, b.end_page, b.confidence FROM {b4_segment_pages} b JOIN {t10_type_hints} h ON b.file_id IS NOT DISTINCT FROM h.file_id WHERE NOT h.construction

-- b20_split_naming
SELECT file_id, start_page, printf('%s_part_%03d', file_id, cast(row_number() OVER (PARTITION BY file_id ORDER BY start_page) AS int)) AS name, end_page - start_page + 1 AS page_count, CASE WHEN start_page = end_page THEN cast(start_page AS string) ELSE concat(cast(start_page AS string), '-', cast(end_page AS string)) END AS page_range FROM {b4_segment_pages}

-- b21_validate_update
SELECT u.file_id, u.start_page, u.end_page, CASE WHEN u.start_page < 1 THEN 'start below 1' WHEN u.end_page < u.start_page THEN 'end before start' WHEN u.end_page > l.last_page THEN 'end beyond file' ELSE 'ok' END AS verdict
FROM (SELECT file_id, start_page - 1 + start_page % 2 AS start_page, end_page + CASE WHEN start_page % 5 = 0 THEN 9 ELSE 0 END AS end_page FROM {truth}) u JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_doc} GROUP BY file_id) l ON u.file_id IS NOT DISTINCT FROM l.file_id

-- b22_early_optimize
SELECT file_id, avg_confidence, n_found, (avg_confidence >= 0.75::double AND expected BETWEEN 2 AND 20) AS downgrade FROM (SELECT b.file_id, round_even(avg(b.confidence), 9) AS avg_confidence, count(*) AS n_found, count(*) * 10 / 3::double AS expected
FROM {b4_segment_pages} b JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_doc} GROUP BY file_id) l ON b.file_id IS NOT DISTINCT FROM l.file_id AND b.start_page <= 0.3::double * l.last_page GROUP BY b.file_id)

-- b23_low_confidence
SELECT file_id, start_page, confidence FROM {b4_segment_pages} WHERE confidence < 0.7::double

