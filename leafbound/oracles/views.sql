-- page_blocks
SELECT source, block, sum(n) OVER (PARTITION BY source ORDER BY block ROWS UNBOUNDED PRECEDING) - n AS before
FROM (SELECT source, block, count(*) AS n FROM (SELECT source, cast(floor(doc_id / 256::double) AS bigint) AS block FROM {documents}) GROUP BY source, block)

-- pages_doc
SELECT d.source AS file_id, cast(o.before + row_number() OVER (PARTITION BY d.source, d.block ORDER BY d.doc_id) AS int) AS page_number, d.doc_id, coalesce(d.text, '') AS text, 612::double AS width, 792::double AS height,
  cast(len(regexp_extract_all(coalesce(d.text, ''), '[^ \t\n\r\f]+', 0)) AS int) AS word_count, d.lang
FROM (SELECT source, doc_id, text, lang, cast(floor(doc_id / 256::double) AS bigint) AS block FROM {documents}) d
JOIN {page_blocks} o ON d.source IS NOT DISTINCT FROM o.source AND d.block IS NOT DISTINCT FROM o.block

-- pages_seeded
SELECT file_id, page_number, doc_id, width, height, lang, text, cast(len(regexp_extract_all(text, '[^ \t\n\r\f]+', 0)) AS int) AS word_count,
  (doc_id % 6 = 0) AS has_images, (doc_id % 5 = 1) AS has_tables,
  CASE WHEN doc_id % 8 = 0 THEN NULL ELSE cast(doc_id % 101 AS double) / 100 END AS ocr_confidence, cast(doc_id % 4 AS int) AS n_issues
FROM (SELECT file_id, page_number, doc_id, width, height, lang, concat(CASE doc_id % 12
    WHEN 0 THEN concat('From: a@b.org', chr(10), 'To: c@d.org', chr(10), 'Subject: site visit', chr(10), 'Date: 2024-03-05', chr(10), 'Dear all, please see attached. Regards', chr(10))
    WHEN 1 THEN concat('INVOICE #', cast(doc_id AS string), chr(10), 'Bill to: client', chr(10), 'Total amount $1,200.50 payment due 03/04/2024', chr(10))
    WHEN 2 THEN concat('REQUEST FOR INFORMATION #', cast(doc_id AS string), chr(10), 'RFI #', cast(doc_id AS string), ' response required by May 3, 2024', chr(10))
    WHEN 3 THEN concat('SUBMITTAL #', cast(doc_id AS string), chr(10), 'SHOP DRAWING and PRODUCT DATA', chr(10))
    WHEN 4 THEN concat('COST PROPOSAL #', cast(doc_id AS string), chr(10), 'CHANGE ORDER # 7 COST IMPACT', chr(10))
    WHEN 5 THEN concat('Page 1 of 3', chr(10))
    WHEN 6 THEN concat('APPLICATION FOR PAYMENT', chr(10), 'SCHEDULE OF VALUES', chr(10))
    WHEN 7 THEN concat('Dear Sir, this contract and agreement between the parties, section 4 and article 5. Sincerely', chr(10))
    WHEN 8 THEN concat('DAILY REPORT', chr(10), 'WEATHER CONDITIONS and MANPOWER ON SITE', chr(10))
    WHEN 9 THEN concat('MEETING MINUTES', chr(10), 'ATTENDEES: four. ACTION ITEMS: none. Quotation # 12', chr(10))
    ELSE '' END, text) AS text
  FROM {pages_doc})

-- page_heads
SELECT p.*, left(text, 500) AS h500, left(text, 1000) AS h1000, lower(left(text, 500)) AS l500, lower(left(text, 1000)) AS l1000 FROM {pages_seeded} p

-- page_edges
SELECT h.*, list_transform(CASE WHEN len(lines) > 10 THEN concat((lines)[1:(1) + (5) - 1], (lines)[-5:]) ELSE lines END, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) AS edge FROM (SELECT p.*, string_split_regex(text, '\n') AS lines FROM {page_heads} p) h

-- visual
SELECT file_id, page_number, doc_id, width, height, word_count, text,
  cast(1 + doc_id % 3 AS int) AS num_columns, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 8 + (doc_id % 5) * 1.5::double END AS font_size, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('family', cast(doc_id % 3 AS string)) END AS font_family,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'left' ELSE 'justify' END AS alignment, concat('bg', cast(doc_id % 2 AS string)) AS background, concat('ink', cast(doc_id % 3 AS string)) AS ink, (doc_id % 4 = 0) AS color_images,
  (doc_id % 3 = 0) AS has_header, (doc_id % 4 < 2) AS has_footer, CASE WHEN doc_id % 3 = 0 THEN concat('head', cast(doc_id % 5 AS string)) END AS header_text, CASE WHEN doc_id % 4 < 2 THEN concat('foot', cast(doc_id % 6 AS string)) END AS footer_text,
  cast(doc_id % 4 AS int) AS num_images, cast(doc_id % 5 % 4 AS int) AS num_tables, cast(doc_id % 3 AS int) AS num_charts, (doc_id % 17 = 0) AS has_logo, (doc_id % 19 = 0) AS has_signature,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE cast(20 + doc_id * 7 % 60 AS double) END AS margin_top, cast(20 + doc_id * 11 % 50 AS double) AS margin_bottom, cast(doc_id * 13 % 70 AS double) AS margin_left, cast(10 + doc_id * 17 % 60 AS double) AS margin_right,
  CASE WHEN doc_id % 13 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, CASE WHEN doc_id % 13 = 0 THEN 792::double / 612::double ELSE 612::double / 792::double END AS aspect, cast(doc_id % 100 AS double) / 100 AS boundary_score,
  list_value(CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE 'list' END, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END, CASE WHEN doc_id % 5 = 0 THEN 'picture' ELSE 'caption' END) AS layout_types,
  cast(doc_id % 3 AS int) AS n_separators
FROM {pages_doc}

-- blocks
SELECT file_id, page_number, b, CASE (doc_id + b) % 7 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'picture' WHEN 3 THEN 'chart_classification' ELSE 'text' END AS kind,
  cast((doc_id * 31 + b * 173) % 480 AS double) AS x, cast((doc_id * 17 + b * 139) % 700 AS double) AS y, CASE WHEN (doc_id + b) % 9 = 0 THEN 560::double ELSE cast(40 + (doc_id + b * 37) % 90 AS double) END AS w, CASE WHEN (doc_id + b) % 9 = 0 THEN 2::double ELSE cast(10 + (doc_id * 3 + b * 29) % 60 AS double) END AS h,
  concat('block ', cast(b AS string)) AS block_text, 8 + (doc_id + b) % 4 * 2::double AS font_size, concat('f', cast((doc_id + b) % 3 AS string)) AS font_family
FROM (SELECT file_id, page_number, doc_id, unnest(generate_series(1, 4 + doc_id % 3)) AS b FROM {pages_doc})

-- truth
SELECT file_id, page_number AS start_page, coalesce(lead(page_number) OVER (PARTITION BY file_id ORDER BY page_number) - 1, last_page) AS end_page, kind
FROM (SELECT p.file_id, p.page_number, max(p.page_number) OVER (PARTITION BY p.file_id) AS last_page, (l.quality = 1 AND p.doc_id % 3 = 0) OR p.page_number = 1 AS starts,
    CASE p.doc_id % 4 WHEN 0 THEN 'Email' WHEN 1 THEN 'Invoice' WHEN 2 THEN 'Request for Information' ELSE 'Submittal' END AS kind
  FROM {pages_doc} p LEFT JOIN {labels} l ON p.doc_id = l.doc_id)
WHERE starts

-- tasks
SELECT event_id AS task_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'low' ELSE 'normal' END AS priority,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, value
FROM {events}

-- s1_pages_scan
SELECT file_id, page_number, word_count, cast(length(text) AS bigint) AS n_chars, (contains(text, chr(9)) OR contains(text, '  ')) AS has_tables FROM {pages_doc}

-- s2_page_range
SELECT file_id, page_number, word_count FROM {pages_doc} WHERE page_number BETWEEN 3 AND 7

-- s3_convert
SELECT file_id, count(*) AS n_pages, cast(sum(length(text)) + count(*) - 1 AS bigint) AS n_chars FROM {pages_doc} GROUP BY file_id

-- s5_ground_truth
SELECT file_id, cast(list_extract(string_split_regex(r, '-'), 1) AS int) AS start_page, cast(CASE WHEN contains(r, '-') THEN list_extract(string_split_regex(r, '-'), 2) ELSE r END AS int) AS end_page, kind
FROM (SELECT file_id, kind, CASE WHEN start_page = end_page THEN cast(start_page AS string) ELSE concat(cast(start_page AS string), '-', cast(end_page AS string)) END AS r FROM {truth})

-- s6_file_metadata
SELECT file_id, count(*) AS n_pages, min(doc_id) AS first_doc, max(doc_id) AS last_doc, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM {pages_doc} GROUP BY file_id

-- s7_text_page
SELECT file_id, page_number, word_count, has_images, has_tables, (word_count < 50) AS mostly_empty, (coalesce(ocr_confidence < 0.6::double, false) OR n_issues > 2) AS needs_review FROM {pages_seeded}

