-- t1_email_header
SELECT file_id, page_number, m AS n_fields, CASE WHEN m >= 2 THEN least(0.9::double, 0.3::double * m) END AS confidence FROM (SELECT file_id, page_number, (cast(regexp_matches(h1000, '(?im)^From:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^To:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^Subject:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^Date:\s*(.+)$') AS int) + cast(regexp_matches(h1000, '(?im)^Sent:\s*(.+)$') AS int)) AS m FROM {page_heads})

-- t2_document_header
SELECT file_id, page_number, heading, CASE WHEN heading IS NOT NULL THEN 0.85::double END AS confidence FROM (SELECT file_id, page_number, CASE WHEN regexp_matches(l500, '(?i)(?:invoice|inv)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'invoice' WHEN regexp_matches(l500, '(?i)(?:purchase\s*order|p\.?o\.?)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'purchase_order' WHEN regexp_matches(l500, '(?i)(?:quote|quotation)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'quote' WHEN regexp_matches(l500, '(?i)(?:contract)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'contract' WHEN regexp_matches(l500, '(?i)(?:submittal)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'submittal' WHEN regexp_matches(l500, '(?i)(?:rfi|request\s*for\s*information)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'rfi' WHEN regexp_matches(l500, '(?i)(?:proposal|cost\s*proposal)\s*(?:#|no\.?|number)?\s*:?\s*(\d+)') THEN 'proposal' WHEN regexp_matches(l500, '(?i)(?:application\s*for\s*payment)') THEN 'application' WHEN regexp_matches(l500, '(?i)(?:schedule\s*of\s*values)') THEN 'schedule' END AS heading FROM {page_heads})

-- t3_page_number_reset
SELECT file_id, page_number, CASE WHEN len(list_filter(edge, lambda s: regexp_matches(s, '(?i)^\s*(?:page\s*)?1\s*(?:of\s*\d+)?\s*$') OR regexp_matches(s, '^\s*-?\s*1\s*-?\s*$') OR regexp_matches(s, '(?i)(?:page|p\.?)\s*1\b'))) > 0 THEN 0.7::double END AS confidence FROM {page_edges}

-- t4_white_space
SELECT file_id, page_number, word_count, CASE WHEN word_count < 50 THEN least(0.8::double, 0.5::double + 0.3::double * (1 - word_count / 50::double)) END AS confidence FROM {pages_seeded}

-- t5_document_type
SELECT file_id, page_number, CASE WHEN text = '' THEN NULL WHEN (cast(regexp_matches(h500, '(?im)^From:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^To:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Subject:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Date:\s*(.+)$') AS int) + cast(regexp_matches(h500, '(?im)^Sent:\s*(.+)$') AS int)) >= 2 THEN 'email' WHEN (contains(l1000, 'invoice') OR contains(l1000, 'bill to') OR contains(l1000, 'ship to') OR contains(l1000, 'total amount')) THEN 'invoice'
  WHEN (contains(l1000, 'purchase order') OR contains(l1000, 'p.o.') OR contains(l1000, 'po number')) THEN 'invoice' WHEN (contains(l1000, 'quotation') OR contains(l1000, 'quote') OR contains(l1000, 'estimate')) THEN 'other'
  WHEN contains(l1000, 'contract') AND contains(l1000, 'agreement') THEN 'contract'
  WHEN (contains(l1000, 'request for information') OR contains(l1000, 'rfi') OR contains(l1000, 'submittal') OR contains(l1000, 'proposal') OR contains(l1000, 'cost proposal') OR contains(l1000, 'schedule of values')) THEN 'report' WHEN contains(l1000, 'application for payment') THEN 'form'
  WHEN (contains(l1000, 'executive summary') OR contains(l1000, 'table of contents') OR contains(l1000, 'introduction') OR contains(l1000, 'conclusion')) THEN 'report' WHEN (contains(l1000, 'dear') OR contains(l1000, 'sincerely') OR contains(l1000, 'regards') OR contains(l1000, 'yours truly')) THEN 'letter' ELSE 'other' END AS document_type FROM {page_heads}

-- t6_construction_pattern
SELECT file_id, page_number, family, CASE family WHEN 'rfi' THEN 0.9::double WHEN 'submittal' THEN 0.85::double WHEN 'change_order' THEN 0.9::double WHEN 'daily_report' THEN 0.8::double WHEN 'safety_document' THEN 0.85::double WHEN 'meeting_minutes' THEN 0.8::double END AS confidence FROM (SELECT file_id, page_number, CASE WHEN (cast(regexp_matches(h1000, '(?im)RFI\s*#?\s*\d+') AS int) + cast(regexp_matches(h1000, '(?im)REQUEST\s+FOR\s+INFORMATION') AS int) + cast(regexp_matches(h1000, '(?im)RFI\s+LOG\s+NO') AS int) + cast(regexp_matches(h1000, '(?im)RESPONSE\s+REQUIRED\s+BY') AS int)) >= 2 THEN 'rfi' WHEN (cast(regexp_matches(h1000, '(?im)SUBMITTAL\s*#?\s*\d+') AS int) + cast(regexp_matches(h1000, '(?im)SUBMITTAL\s+TRANSMITTAL') AS int) + cast(regexp_matches(h1000, '(?im)SHOP\s+DRAWING') AS int) + cast(regexp_matches(h1000, '(?im)PRODUCT\s+DATA') AS int) + cast(regexp_matches(h1000, '(?im)MATERIAL\s+SAMPLE') AS int)) >= 2 THEN 'submittal' WHEN (cast(regexp_matches(h1000, '(?im)CHANGE\s+ORDER\s*#?\s*\d+') AS int) + cast(regexp_matches(h1000, '(?im)CONTRACT\s+MODIFICATION') AS int) + cast(regexp_matches(h1000, '(?im)COST\s+IMPACT') AS int) + cast(regexp_matches(h1000, '(?im)SCHEDULE\s+IMPACT') AS int) + cast(regexp_matches(h1000, '(?im)PCO\s*#?\s*\d+') AS int)) >= 2 THEN 'change_order' WHEN (cast(regexp_matches(h1000, '(?im)DAILY\s+(?:CONSTRUCTION\s+)?REPORT') AS int) + cast(regexp_matches(h1000, '(?im)WEATHER\s+CONDITIONS') AS int) + cast(regexp_matches(h1000, '(?im)MANPOWER\s+ON\s+SITE') AS int) + cast(regexp_matches(h1000, '(?im)WORK\s+PERFORMED\s+TODAY') AS int) + cast(regexp_matches(h1000, '(?im)EQUIPMENT\s+ON\s+SITE') AS int)) >= 2 THEN 'daily_report' WHEN (cast(regexp_matches(h1000, '(?im)SAFETY\s+(?:MEETING|REPORT|INSPECTION)') AS int) + cast(regexp_matches(h1000, '(?im)JOB\s+HAZARD\s+ANALYSIS') AS int) + cast(regexp_matches(h1000, '(?im)INCIDENT\s+REPORT') AS int) + cast(regexp_matches(h1000, '(?im)NEAR\s+MISS') AS int) + cast(regexp_matches(h1000, '(?im)TOOLBOX\s+TALK') AS int)) >= 2 THEN 'safety_document' WHEN (cast(regexp_matches(h1000, '(?im)MEETING\s+MINUTES') AS int) + cast(regexp_matches(h1000, '(?im)ATTENDEES\s*:') AS int) + cast(regexp_matches(h1000, '(?im)ACTION\s+ITEMS') AS int) + cast(regexp_matches(h1000, '(?im)NEXT\s+MEETING') AS int) + cast(regexp_matches(h1000, '(?im)OAC\s+MEETING') AS int)) >= 2 THEN 'meeting_minutes' END AS family FROM {page_heads})

-- t7_quick_check
SELECT file_id, page_number, (((cast(contains(t, 'from:') AS int) + cast(contains(t, 'to:') AS int) + cast(contains(t, 'subject:') AS int) + cast(contains(t, 'date:') AS int) + cast(contains(t, 'sent:') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)^From:\s*') AS int) + cast(regexp_matches(t, '(?im)^To:\s*') AS int) + cast(regexp_matches(t, '(?im)^Subject:\s*') AS int)) >= 1) OR ((cast(contains(t, 'invoice') AS int) + cast(contains(t, 'bill to') AS int) + cast(contains(t, 'ship to') AS int) + cast(contains(t, 'total') AS int) + cast(contains(t, 'amount due') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)Invoice\s*#') AS int) + cast(regexp_matches(t, '(?im)Invoice\s+Number') AS int)) >= 1) OR ((cast(contains(t, 'rfi') AS int) + cast(contains(t, 'request for information') AS int) + cast(contains(t, 'response required') AS int) + cast(contains(t, 'clarification') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)RFI\s*#?\s*\d+') AS int) + cast(regexp_matches(t, '(?im)REQUEST\s+FOR\s+INFORMATION') AS int)) >= 1) OR ((cast(contains(t, 'submittal') AS int) + cast(contains(t, 'shop drawing') AS int) + cast(contains(t, 'product data') AS int) + cast(contains(t, 'material sample') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)SUBMITTAL\s*#?\s*\d+') AS int) + cast(regexp_matches(t, '(?im)SUBMITTAL\s+TRANSMITTAL') AS int)) >= 1) OR ((cast(contains(t, 'change order') AS int) + cast(contains(t, 'contract modification') AS int) + cast(contains(t, 'cost impact') AS int) + cast(contains(t, 'pco') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)CHANGE\s+ORDER\s*#?\s*\d+') AS int) + cast(regexp_matches(t, '(?im)PCO\s*#?\s*\d+') AS int)) >= 1) OR ((cast(contains(t, 'agreement') AS int) + cast(contains(t, 'terms and conditions') AS int) + cast(contains(t, 'whereas') AS int) + cast(contains(t, 'party') AS int) + cast(contains(t, 'obligations') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)CONTRACT') AS int) + cast(regexp_matches(t, '(?im)AGREEMENT') AS int)) >= 1) OR ((cast(contains(t, 'dear') AS int) + cast(contains(t, 'sincerely') AS int) + cast(contains(t, 'regards') AS int) + cast(contains(t, 'attention') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)^Dear\s+') AS int) + cast(regexp_matches(t, '(?im)RE:\s*') AS int) + cast(regexp_matches(t, '(?im)ATTENTION:\s*') AS int)) >= 1) OR ((cast(contains(t, 'executive summary') AS int) + cast(contains(t, 'table of contents') AS int) + cast(contains(t, 'findings') AS int) + cast(contains(t, 'recommendations') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)TABLE\s+OF\s+CONTENTS') AS int) + cast(regexp_matches(t, '(?im)EXECUTIVE\s+SUMMARY') AS int)) >= 1) OR coalesce(abs(n - prev) / greatest(n, prev, 1::double) > 0.7::double, false)) AS potential,
  greatest(CASE WHEN ((cast(contains(t, 'from:') AS int) + cast(contains(t, 'to:') AS int) + cast(contains(t, 'subject:') AS int) + cast(contains(t, 'date:') AS int) + cast(contains(t, 'sent:') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)^From:\s*') AS int) + cast(regexp_matches(t, '(?im)^To:\s*') AS int) + cast(regexp_matches(t, '(?im)^Subject:\s*') AS int)) >= 1) THEN 0.1::double ELSE 0::double END, CASE WHEN ((cast(contains(t, 'invoice') AS int) + cast(contains(t, 'bill to') AS int) + cast(contains(t, 'ship to') AS int) + cast(contains(t, 'total') AS int) + cast(contains(t, 'amount due') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)Invoice\s*#') AS int) + cast(regexp_matches(t, '(?im)Invoice\s+Number') AS int)) >= 1) THEN 0.05::double ELSE 0::double END, CASE WHEN ((cast(contains(t, 'rfi') AS int) + cast(contains(t, 'request for information') AS int) + cast(contains(t, 'response required') AS int) + cast(contains(t, 'clarification') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)RFI\s*#?\s*\d+') AS int) + cast(regexp_matches(t, '(?im)REQUEST\s+FOR\s+INFORMATION') AS int)) >= 1) THEN 0.15::double ELSE 0::double END, CASE WHEN ((cast(contains(t, 'submittal') AS int) + cast(contains(t, 'shop drawing') AS int) + cast(contains(t, 'product data') AS int) + cast(contains(t, 'material sample') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)SUBMITTAL\s*#?\s*\d+') AS int) + cast(regexp_matches(t, '(?im)SUBMITTAL\s+TRANSMITTAL') AS int)) >= 1) THEN 0.15::double ELSE 0::double END, CASE WHEN ((cast(contains(t, 'change order') AS int) + cast(contains(t, 'contract modification') AS int) + cast(contains(t, 'cost impact') AS int) + cast(contains(t, 'pco') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)CHANGE\s+ORDER\s*#?\s*\d+') AS int) + cast(regexp_matches(t, '(?im)PCO\s*#?\s*\d+') AS int)) >= 1) THEN 0.15::double ELSE 0::double END, CASE WHEN ((cast(contains(t, 'agreement') AS int) + cast(contains(t, 'terms and conditions') AS int) + cast(contains(t, 'whereas') AS int) + cast(contains(t, 'party') AS int) + cast(contains(t, 'obligations') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)CONTRACT') AS int) + cast(regexp_matches(t, '(?im)AGREEMENT') AS int)) >= 1) THEN 0.0::double ELSE 0::double END, CASE WHEN ((cast(contains(t, 'dear') AS int) + cast(contains(t, 'sincerely') AS int) + cast(contains(t, 'regards') AS int) + cast(contains(t, 'attention') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)^Dear\s+') AS int) + cast(regexp_matches(t, '(?im)RE:\s*') AS int) + cast(regexp_matches(t, '(?im)ATTENTION:\s*') AS int)) >= 1) THEN 0.0::double ELSE 0::double END, CASE WHEN ((cast(contains(t, 'executive summary') AS int) + cast(contains(t, 'table of contents') AS int) + cast(contains(t, 'findings') AS int) + cast(contains(t, 'recommendations') AS int)) >= 2 OR (cast(regexp_matches(t, '(?im)TABLE\s+OF\s+CONTENTS') AS int) + cast(regexp_matches(t, '(?im)EXECUTIVE\s+SUMMARY') AS int)) >= 1) THEN 0.0::double ELSE 0::double END) AS boost
FROM (SELECT file_id, page_number, lower(text) AS t, cast(length(text) AS double) AS n, cast(lag(length(text)) OVER (PARTITION BY file_id ORDER BY page_number) AS double) AS prev FROM {pages_seeded})

-- t8_potential_boundary
SELECT file_id, page_number, (page_number = min(page_number) OVER (PARTITION BY file_id) OR page_number = max(page_number) OVER (PARTITION BY file_id) OR (contains(lower(text), 'from:') OR contains(lower(text), 'to:') OR contains(lower(text), 'subject:') OR contains(lower(text), 'date:') OR contains(lower(text), 'invoice') OR contains(lower(text), 'purchase order') OR contains(lower(text), 'contract') OR contains(lower(text), 'page 1') OR contains(lower(text), '1 of') OR contains(lower(text), 'dear') OR contains(lower(text), 'sincerely') OR contains(lower(text), 'regards') OR contains(lower(text), 'application') OR contains(lower(text), 'form') OR contains(lower(text), 'questionnaire'))) AS potential FROM {pages_seeded}

-- t9_boundary_indicators
SELECT file_id, page_number, (page_number = min(page_number) OVER (PARTITION BY file_id) OR page_number = max(page_number) OVER (PARTITION BY file_id) OR (contains(lower(text), 'from:') OR contains(lower(text), 'to:') OR contains(lower(text), 'subject:') OR contains(lower(text), 'invoice') OR contains(lower(text), 'bill') OR contains(lower(text), 'statement') OR contains(lower(text), 'page 1') OR contains(lower(text), 'page 1 of') OR contains(lower(text), 'dear') OR contains(lower(text), 'sincerely') OR contains(lower(text), 'contract') OR contains(lower(text), 'agreement'))) AS potential FROM {pages_seeded}

-- t10_type_hints
SELECT file_id, bool_or(contains(t, 'rfi') OR contains(t, 'submittal')) AS construction, bool_or(contains(t, 'from:') AND contains(t, 'to:')) AS email, bool_or(contains(t, 'invoice') OR contains(t, 'purchase order')) AS business
FROM (SELECT file_id, lower(left(text, 500)) AS t FROM {pages_seeded} WHERE page_number <= 3) GROUP BY file_id

-- t11_truncate_words
SELECT file_id, page_number, CASE WHEN length(text) <= 300 THEN text WHEN last > 240 THEN concat(left(text, cast(last AS int)), '...') ELSE concat(left(text, 300), '...') END AS cut
FROM (SELECT file_id, page_number, text, 300 - instr(reverse(left(text, 300)), ' ') AS last FROM {pages_seeded})

-- t12_truncate_sentence
SELECT file_id, page_number, CASE WHEN text = '' THEN '[EMPTY]' WHEN length(text) <= 300 THEN text WHEN stop > 210 THEN left(text, cast(stop + 1 AS int)) WHEN gap > 240 THEN concat(left(text, cast(gap AS int)), '...') ELSE concat(left(text, 300), '...') END AS cut
FROM (SELECT file_id, page_number, text, CASE WHEN instr(r, '.') + instr(r, chr(10)) = 0 THEN -1 ELSE 300 - least(CASE WHEN instr(r, '.') > 0 THEN instr(r, '.') ELSE 301 END, CASE WHEN instr(r, chr(10)) > 0 THEN instr(r, chr(10)) ELSE 301 END) END AS stop,
    CASE WHEN instr(r, ' ') = 0 THEN -1 ELSE 300 - instr(r, ' ') END AS gap
  FROM (SELECT file_id, page_number, text, reverse(left(text, 300)) AS r FROM {pages_seeded}))

-- t13_text_snippets
SELECT file_id, page_number, left(text, 500) AS current, coalesce(right(lag(text) OVER w, 200), 'N/A') AS previous, coalesce(left(lead(text) OVER w, 200), 'N/A') AS following
FROM {pages_seeded} WINDOW w AS (PARTITION BY file_id ORDER BY page_number)

-- t14_prompt_render
SELECT file_id, page_number, style, concat(says, chr(10), 'Page ', cast(page_number AS string), ': ', left(text, 200), chr(10), 'Answer in JSON with is_boundary, confidence, reasoning, document_type.') AS prompt
FROM {pages_seeded} CROSS JOIN (VALUES ('concise', 'Does a new document start here?'), ('structured', 'Weigh headers, layout and topic, then decide whether a new document starts.'), ('few_shot', 'Example: a page with From: and Subject: lines starts an e-mail.'), ('cot_financial', 'Reason step by step over numbers, dates and parties.'), ('detailed_construction', 'Construction papers: look at RFI, submittal and change order numbers.'), ('trade_construction', 'You know building sites. Does a new request, submittal, change order, report or minutes begin?'), ('trade_email', 'Does a new message begin, or does an earlier one of the chain go on?'), ('trade_financial', 'Does a new invoice, order, quotation or statement begin? Numbers and totals tell.'), ('trade_mixed', 'Any kind of paper may follow any other. Does one begin here?')) v(style, says)

-- t15_prompt_select
SELECT file_id, page_number, CASE WHEN contains(t, 'rfi') OR contains(t, 'submittal') OR contains(t, 'change order') THEN 'detailed_construction' WHEN contains(t, 'from:') THEN 'few_shot' WHEN contains(t, 'invoice') OR contains(t, 'purchase order') OR contains(t, 'quot') THEN 'cot_financial'
  WHEN contains(t, 'dear') OR contains(t, 'contract') THEN 'structured' ELSE 'concise' END AS style FROM (SELECT file_id, page_number, lower(left(text, 500)) AS t FROM {pages_seeded})

-- t16_prompt_adaptive
SELECT file_id, style, accuracy FROM (SELECT file_id, style, accuracy, row_number() OVER (PARTITION BY file_id ORDER BY accuracy DESC, style) AS r
  FROM (SELECT s.file_id, s.style, sum(CASE WHEN t.file_id IS NOT NULL THEN 1 ELSE 0 END) / cast(count(*) AS double) AS accuracy FROM {t15_prompt_select} s LEFT JOIN {truth} t ON s.file_id IS NOT DISTINCT FROM t.file_id AND s.page_number = t.start_page GROUP BY s.file_id, s.style)) WHERE r = 1

-- t17_prompt_optimize
SELECT file_id, page_number, CASE WHEN length(p) > 14000 THEN left(p, 14000) ELSE p END AS prompt FROM (SELECT file_id, page_number, concat(regexp_replace(regexp_replace(text, '\n[ \t\n]*\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10), 'Reply with JSON only.') AS p FROM {pages_seeded})

-- t18_llm_json_parse
SELECT event_id, coalesce(json_extract_string(j, '$.is_boundary') = 'true', false) AS is_boundary, coalesce(cast(json_extract_string(j, '$.confidence') AS double), 0.5::double) AS confidence, json_extract_string(j, '$.document_type') AS document_type
FROM (SELECT event_id, regexp_extract(r, '(?s)\{.*\}', 0) AS j FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no json here' ELSE concat('Sure. {"is_boundary": ', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(', "confidence": 0.', cast(event_id % 9 + 1 AS string)) END, ', "document_type": "', CASE event_id % 5 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'RFI' WHEN 2 THEN 'purchase order' WHEN 3 THEN 'memo' ELSE 'email' END, '"} done') END AS r FROM {events})) WHERE j <> ''

-- t19_llm_type_map
SELECT event_id, CASE lower(document_type) WHEN 'email' THEN 'email' WHEN 'email chain' THEN 'email' WHEN 'invoice' THEN 'invoice' WHEN 'purchase order' THEN 'invoice' WHEN 'purchase_order' THEN 'invoice' WHEN 'contract' THEN 'contract' WHEN 'report' THEN 'report' WHEN 'rfi' THEN 'report' WHEN 'submittal' THEN 'report' WHEN 'letter' THEN 'letter' WHEN 'form' THEN 'form' WHEN 'presentation' THEN 'presentation' WHEN 'spreadsheet' THEN 'spreadsheet' WHEN 'proposal' THEN 'report' ELSE 'other' END AS document_type FROM {t18_llm_json_parse}

-- t20_llm_text_fallback
SELECT event_id, (contains(lower(r), 'yes') OR contains(lower(r), 'boundary: true')) AS is_boundary, coalesce(cast(nullif(regexp_extract(r, 'confidence[^0-9]*([0-9]+\.[0-9]+)', 1), '') AS double), 0.5::double) AS confidence
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('Yes, confidence 0.', cast(event_id % 9 + 1 AS string)) WHEN 1 THEN 'No new document.' ELSE 'boundary: true' END AS r FROM {events})

-- t21_prepare_page_text
SELECT file_id, page_number, left(array_to_string(concat(list_filter(l, lambda s: regexp_matches(s, '^[A-Z][^a-z]*$') OR contains(s, ':')), list_filter(l, lambda s: NOT (regexp_matches(s, '^[A-Z][^a-z]*$') OR contains(s, ':')))), chr(10)), 400) AS prepared
FROM (SELECT file_id, page_number, list_filter(list_transform(string_split_regex(text, '\n'), lambda s: regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), '^ | $', '', 'g')), lambda s: s <> '') AS l FROM {pages_seeded})

