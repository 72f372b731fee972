-- w1_layout_change
SELECT file_id, page_number, CASE WHEN prev IS NOT NULL AND abs(d - prev) / greatest(prev, d, 0.001::double) > 0.5::double THEN 0.6::double END AS confidence
FROM (SELECT file_id, page_number, d, lag(d) OVER w AS prev FROM (SELECT file_id, page_number, CASE WHEN width <= 0 OR height <= 0 THEN 0::double ELSE word_count / (width * height) END AS d FROM {pages_seeded}) WINDOW w AS (PARTITION BY file_id ORDER BY page_number))

-- w2_type_change
SELECT file_id, page_number, CASE WHEN kind <> prev THEN 0.8::double END AS confidence FROM (SELECT file_id, page_number, kind, lag(kind) OVER w AS prev FROM (SELECT file_id, page_number, CASE WHEN text = '' THEN NULL WHEN (cast(regexp_matches(h500, '(?im)^From:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^To:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Subject:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Date:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Sent:\s*(.+)$') AS int)) >= 2 THEN 'email' WHEN (contains(l1000, 'invoice') OR contains(l1000, 'bill to') OR contains(l1000, 'ship to') OR contains(l1000, 'total amount')) THEN 'invoice'
  WHEN (contains(l1000, 'purchase order') OR contains(l1000, 'p.o.') OR contains(l1000, 'po number')) THEN 'invoice' WHEN (contains(l1000, 'quotation') OR contains(l1000, 'quote') OR contains(l1000, 'estimate')) THEN 'other'
  WHEN contains(l1000, 'contract') AND contains(l1000, 'agreement') THEN 'contract'
  WHEN (contains(l1000, 'request for information') OR contains(l1000, 'rfi') OR contains(l1000, 'submittal') OR contains(l1000, 'proposal') OR contains(l1000, 'cost proposal') OR contains(l1000, 'schedule of values')) THEN 'report' WHEN contains(l1000, 'application for payment') THEN 'form'
  WHEN (contains(l1000, 'executive summary') OR contains(l1000, 'table of contents') OR contains(l1000, 'introduction') OR contains(l1000, 'conclusion')) THEN 'report' WHEN (contains(l1000, 'dear') OR contains(l1000, 'sincerely') OR contains(l1000, 'regards') OR contains(l1000, 'yours truly')) THEN 'letter' ELSE 'other' END AS kind FROM {page_heads}) WINDOW w AS (PARTITION BY file_id ORDER BY page_number))

-- w3_construction_boundary
SELECT file_id, page_number, family, (family IS NOT NULL AND (prev IS NULL OR prev <> family)) AS starts FROM (SELECT file_id, page_number, family, lag(family) OVER w AS prev FROM (SELECT file_id, page_number, CASE WHEN (cast(regexp_matches(h1000, '(?im)RFI\s*#?\s*\d+') AS int) + cast(regexp_matches(h1000, '(?im)REQUEST\s+FOR\s+INFORMATION') AS int) + cast(regexp_matches(h1000, '(?im)RFI\s+LOG\s+NO') AS int) + cast(regexp_matches(h1000, '(?im)RESPONSE\s+REQUIRED\s+BY') AS int)) >= 2 THEN 'rfi' WHEN (cast(regexp_matches(h1000, '(?im)SUBMITTAL\s*#?\s*\d+') AS int) + cast(regexp_matches(h1000, '(?im)SUBMITTAL\s+TRANSMITTAL') AS int) + cast(regexp_matches(h1000, '(?im)SHOP\s+DRAWING') AS int) + cast(regexp_matches(h1000, '(?im)PRODUCT\s+DATA') AS int) + cast(regexp_matches(h1000, '(?im)MATERIAL\s+SAMPLE') AS int)) >= 2 THEN 'submittal' WHEN (cast(regexp_matches(h1000, '(?im)CHANGE\s+ORDER\s*#?\s*\d+') AS int) + cast(regexp_matches(h1000, '(?im)CONTRACT\s+MODIFICATION') AS int) + cast(regexp_matches(h1000, '(?im)COST\s+IMPACT') AS int) + cast(regexp_matches(h1000, '(?im)SCHEDULE\s+IMPACT') AS int) + cast(regexp_matches(h1000, '(?im)PCO\s*#?\s*\d+') AS int)) >= 2 THEN 'change_order' WHEN (cast(regexp_matches(h1000, '(?im)DAILY\s+(?:CONSTRUCTION\s+)?REPORT') AS int) + cast(regexp_matches(h1000, '(?im)WEATHER\s+CONDITIONS') AS int) + cast(regexp_matches(h1000, '(?im)MANPOWER\s+ON\s+SITE') AS int) + cast(regexp_matches(h1000, '(?im)WORK\s+PERFORMED\s+TODAY') AS int) + cast(regexp_matches(h1000, '(?im)EQUIPMENT\s+ON\s+SITE') AS int)) >= 2 THEN 'daily_report' WHEN (cast(regexp_matches(h1000, '(?im)SAFETY\s+(?:MEETING|REPORT|INSPECTION)') AS int) + cast(regexp_matches(h1000, '(?im)JOB\s+HAZARD\s+ANALYSIS') AS int) + cast(regexp_matches(h1000, '(?im)INCIDENT\s+REPORT') AS int) + cast(regexp_matches(h1000, '(?im)NEAR\s+MISS') AS int) + cast(regexp_matches(h1000, '(?im)TOOLBOX\s+TALK') AS int)) >= 2 THEN 'safety_document' WHEN (cast(regexp_matches(h1000, '(?im)MEETING\s+MINUTES') AS int) + cast(regexp_matches(h1000, '(?im)ATTENDEES\s*:') AS int) + cast(regexp_matches(h1000, '(?im)ACTION\s+ITEMS') AS int) + cast(regexp_matches(h1000, '(?im)NEXT\s+MEETING') AS int) + cast(regexp_matches(h1000, '(?im)OAC\s+MEETING') AS int)) >= 2 THEN 'meeting_minutes' END AS family FROM {page_heads}) WINDOW w AS (PARTITION BY file_id ORDER BY page_number))

-- w4_visual_change
SELECT file_id, page_number, score, (score > 0.6::double) AS starts FROM (SELECT file_id, page_number, least(1::double,
    CASE WHEN len(list_filter(l, lambda x: NOT list_contains(pl, x))) + len(list_filter(pl, lambda x: NOT list_contains(l, x))) > 2 THEN 0.3::double ELSE 0::double END + CASE WHEN pw > 0 AND abs(word_count - pw) / cast(pw AS double) > 0.5::double THEN 0.2::double ELSE 0::double END
    + CASE WHEN t <> pt THEN 0.2::double ELSE 0::double END + CASE WHEN i <> pi_ THEN 0.2::double ELSE 0::double END + CASE WHEN abs(aspect - pa) > 0.1::double THEN 0.1::double ELSE 0::double END) AS score
  FROM (SELECT file_id, page_number, word_count, aspect, layout_types AS l, num_tables > 0 AS t, num_images > 0 AS i, lag(layout_types) OVER w AS pl, lag(word_count) OVER w AS pw, lag(num_tables > 0) OVER w AS pt, lag(num_images > 0) OVER w AS pi_, lag(aspect) OVER w AS pa FROM {visual} WINDOW w AS (PARTITION BY file_id ORDER BY page_number)) WHERE pw IS NOT NULL)

-- w5_text_length_change
SELECT file_id, page_number, coalesce((p > 100 AND n < 50) OR (p < 50 AND n > 100), false) AS changes FROM (SELECT file_id, page_number, length(text) AS n, lag(length(text)) OVER w AS p FROM {pages_seeded} WINDOW w AS (PARTITION BY file_id ORDER BY page_number))

-- w6_page_context
SELECT conv_id AS file_id, cast(turn + 1 AS bigint) AS page_number, text, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text, 0::double AS confidence FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)

-- w7_near_boundary
SELECT file_id, page_number, (n <= 10 OR max(p) OVER near1 = 1) AS high_quality, (n <= 10 OR max(p) OVER near2 = 1 OR page_number % 5 = 0) AS llm
FROM (SELECT file_id, page_number, count(*) OVER (PARTITION BY file_id) AS n, CASE WHEN page_number = 1 OR (contains(lower(text), 'from:') OR contains(lower(text), 'to:') OR contains(lower(text), 'subject:') OR contains(lower(text), 'invoice') OR contains(lower(text), 'bill') OR contains(lower(text), 'statement') OR contains(lower(text), 'page 1') OR contains(lower(text), 'page 1 of') OR contains(lower(text), 'dear') OR contains(lower(text), 'sincerely') OR contains(lower(text), 'contract') OR contains(lower(text), 'agreement')) THEN 1 ELSE 0 END AS p FROM {pages_seeded})
WINDOW near1 AS (PARTITION BY file_id ORDER BY page_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), near2 AS (PARTITION BY file_id ORDER BY page_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)

-- w8_context_pages
SELECT file_id, page_number, (max(CASE WHEN potential THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY page_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1) AS medium FROM {t8_potential_boundary}

