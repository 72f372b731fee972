-- rule_features
SELECT file_id, page_number, doc_id, word_count, kind, density, lag(kind) OVER w AS prev_kind, lag(density) OVER w AS prev_density, email, heading, reset
FROM (SELECT file_id, page_number, doc_id, word_count, CASE WHEN text = '' THEN NULL WHEN (cast(regexp_matches(h500, '(?im)^From:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^To:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Subject:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Date:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Sent:\s*(.+)$') AS int)) >= 2 THEN 'email' WHEN (contains(l1000, 'invoice') OR contains(l1000, 'bill to') OR contains(l1000, 'ship to') OR contains(l1000, 'total amount')) THEN 'invoice'
  WHEN (contains(l1000, 'purchase order') OR contains(l1000, 'p.o.') OR contains(l1000, 'po number')) THEN 'invoice' WHEN (contains(l1000, 'quotation') OR contains(l1000, 'quote') OR contains(l1000, 'estimate')) THEN 'other'
  WHEN contains(l1000, 'contract') AND contains(l1000, 'agreement') THEN 'contract'
  WHEN (contains(l1000, 'request for information') OR contains(l1000, 'rfi') OR contains(l1000, 'submittal') OR contains(l1000, 'proposal') OR contains(l1000, 'cost proposal') OR contains(l1000, 'schedule of values')) THEN 'report' WHEN contains(l1000, 'application for payment') THEN 'form'
  WHEN (contains(l1000, 'executive summary') OR contains(l1000, 'table of contents') OR contains(l1000, 'introduction') OR contains(l1000, 'conclusion')) THEN 'report' WHEN (contains(l1000, 'dear') OR contains(l1000, 'sincerely') OR contains(l1000, 'regards') OR contains(l1000, 'yours truly')) THEN 'letter' ELSE 'other' END AS kind, CASE WHEN width <= 0 OR height <= 0 THEN 0::double ELSE word_count / (width * height) END AS density, (cast(regexp_matches(h1000, '(?im)^From:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^To:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^Subject:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^Date:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^Sent:\s*(.+)$') AS int)) AS email, CASE WHEN regexp_matches(l500, '(?i)(?:invoice|inv)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'invoice' WHEN regexp_matches(l500, '(?i)(?:purchase\s*order|p\.?o\.?)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'purchase_order' WHEN regexp_matches(l500, '(?i)(?:quote|quotation)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'quote' WHEN regexp_matches(l500, '(?i)(?:contract)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'contract' WHEN regexp_matches(l500, '(?i)(?:submittal)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'submittal' WHEN regexp_matches(l500, '(?i)(?:rfi|request\s*for\s*information)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'rfi' WHEN regexp_matches(l500, '(?i)(?:proposal|cost\s*proposal)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'proposal' WHEN regexp_matches(l500, '(?i)(?:application\s*for\s*payment)') THEN 'application' WHEN regexp_matches(l500, '(?i)(?:schedule\s*of\s*values)') THEN 'schedule' END AS heading, CASE WHEN len(list_filter(edge, lambda s: regexp_matches(s, '(?i)^\s*(?:page\s*)?1\s*(?:of\s*\d+)?\s*$') OR regexp_matches(s, '^\s*-?\s*1\s*-?\s*$') OR regexp_matches(s, '(?i)(?:page|p\.?)\s*1\b'))) > 0 THEN 0.7::double END AS reset
  FROM {page_edges}) WINDOW w AS (PARTITION BY file_id ORDER BY page_number)

-- rule_signals
SELECT file_id, page_number, kind, CASE WHEN email >= 2 THEN least(0.9::double, 0.3::double * email) END AS c1, CASE WHEN heading IS NOT NULL THEN 0.85::double END AS c2, reset AS c3,
  CASE WHEN abs(density - prev_density) / greatest(prev_density, density, 0.001::double) > 0.5::double THEN 0.6::double END AS c4, CASE WHEN word_count < 50 THEN least(0.8::double, 0.5::double + 0.3::double * (1 - word_count / 50::double)) END AS c5, CASE WHEN kind <> prev_kind THEN 0.8::double END AS c6
FROM {rule_features} WHERE page_number > 1

-- b1_collect_signals
SELECT file_id, page_number, signal, confidence FROM (SELECT file_id, page_number, signal, CASE signal WHEN 'email_header' THEN c1 WHEN 'document_header' THEN c2 WHEN 'page_number_reset' THEN c3 WHEN 'layout_change' THEN c4 WHEN 'white_space' THEN c5 WHEN 'document_type_change' THEN c6 END AS confidence FROM (SELECT s.*, unnest(list_value('email_header', 'document_header', 'page_number_reset', 'layout_change', 'white_space', 'document_type_change')) AS signal FROM {rule_signals} s)) WHERE confidence IS NOT NULL

-- b2_rule_confidence
SELECT file_id, page_number, kind, n_signals, CASE WHEN n_signals = 0 THEN 0::double WHEN strong >= 2 THEN least(1::double, num / den * 1.2::double) ELSE num / den END AS confidence
FROM (SELECT file_id, page_number, kind, CASE WHEN c1 IS NULL THEN 0 ELSE 1 END + CASE WHEN c2 IS NULL THEN 0 ELSE 1 END + CASE WHEN c3 IS NULL THEN 0 ELSE 1 END + CASE WHEN c4 IS NULL THEN 0 ELSE 1 END + CASE WHEN c5 IS NULL THEN 0 ELSE 1 END + CASE WHEN c6 IS NULL THEN 0 ELSE 1 END AS n_signals, coalesce(c1 * 0.9::double, 0::double) + coalesce(c2 * 0.85::double, 0::double) + coalesce(c3 * 0.7::double, 0::double) + coalesce(c4 * 0.6::double, 0::double) + coalesce(c5 * 0.5::double, 0::double) + coalesce(c6 * 0.8::double, 0::double) AS num, CASE WHEN c1 IS NULL THEN 0::double ELSE 0.9::double END + CASE WHEN c2 IS NULL THEN 0::double ELSE 0.85::double END + CASE WHEN c3 IS NULL THEN 0::double ELSE 0.7::double END + CASE WHEN c4 IS NULL THEN 0::double ELSE 0.6::double END + CASE WHEN c5 IS NULL THEN 0::double ELSE 0.5::double END + CASE WHEN c6 IS NULL THEN 0::double ELSE 0.8::double END AS den, CASE WHEN c1 >= 0.7::double THEN 1 ELSE 0 END + CASE WHEN c2 >= 0.7::double THEN 1 ELSE 0 END + CASE WHEN c3 >= 0.7::double THEN 1 ELSE 0 END + CASE WHEN c4 >= 0.7::double THEN 1 ELSE 0 END + CASE WHEN c5 >= 0.7::double THEN 1 ELSE 0 END + CASE WHEN c6 >= 0.7::double THEN 1 ELSE 0 END AS strong FROM {rule_signals})

-- b3_threshold
SELECT file_id, page_number, kind, n_signals, confidence FROM {b2_rule_confidence} WHERE confidence >= 0.6::double AND n_signals >= 1

-- b4_segment_pages
SELECT s.file_id, s.page_number AS start_page, coalesce(lead(s.page_number) OVER (PARTITION BY s.file_id ORDER BY s.page_number) - 1, l.last_page) AS end_page, s.confidence, s.kind AS document_type
FROM (SELECT file_id, page_number, 1::double AS confidence, kind FROM {rule_features} WHERE page_number = 1 UNION ALL SELECT file_id, page_number, confidence, kind FROM {b3_threshold}) s JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_seeded} GROUP BY file_id) l ON s.file_id IS NOT DISTINCT FROM l.file_id

-- feedback
SELECT p.file_id, p.page_number, (l.quality = 1) AS is_boundary FROM {pages_doc} p JOIN {labels} l ON p.doc_id = l.doc_id

-- b5_refine_feedback
SELECT s.file_id, s.page_number AS start_page, coalesce(lead(s.page_number) OVER (PARTITION BY s.file_id ORDER BY s.page_number) - 1, l.last_page) AS end_page, s.confidence, s.kind AS document_type
FROM (
SELECT b.file_id, b.start_page AS page_number, b.confidence, b.document_type AS kind FROM {b4_segment_pages} b WHERE NOT EXISTS (SELECT 1 FROM {feedback} f WHERE f.file_id IS NOT DISTINCT FROM b.file_id AND f.page_number = b.start_page AND NOT f.is_boundary)
UNION ALL SELECT r.file_id, r.page_number, 1::double AS confidence, r.kind FROM {rule_features} r JOIN {feedback} f ON f.file_id IS NOT DISTINCT FROM r.file_id AND f.page_number = r.page_number
  WHERE f.is_boundary AND NOT EXISTS (SELECT 1 FROM {b4_segment_pages} b WHERE b.file_id IS NOT DISTINCT FROM r.file_id AND b.start_page = r.page_number)) s JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_seeded} GROUP BY file_id) l ON s.file_id IS NOT DISTINCT FROM l.file_id

