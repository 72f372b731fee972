-- p1_basic_cleanup
SELECT file_id, page_number, array_to_string(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]', '', 'g'), '[ 	]+', ' ', 'g'), '
{3,}', concat(chr(10), chr(10)), 'g'), '\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), chr(10)) AS text, CASE WHEN regexp_matches(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]') THEN 1 ELSE 0 END AS n_corrections FROM {ocr_pages}

-- p3_word_boundaries
WITH a AS (SELECT file_id, page_number, text, regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g') AS parted, len(regexp_extract_all(text, '[a-z][A-Z]')) AS n FROM {p1_basic_cleanup})
SELECT file_id, page_number, regexp_replace(parted, '([a-z])-\n([a-z])', '\1\2', 'g') AS text, (n + len(regexp_extract_all(parted, '[a-z]-\n[a-z]')))::bigint AS n_corrections FROM a

-- p5_formatting
WITH a AS (SELECT file_id, page_number, text, regexp_replace(regexp_replace(text, '([.!?])([A-Z])', '\1 \2', 'g'), '([,;:])([A-Za-z])', '\1 \2', 'g') AS t FROM {p1_basic_cleanup}),
b AS (SELECT file_id, page_number, text, regexp_replace(regexp_replace(regexp_replace(t, '\s+([.!?,;:])', '\1', 'g'), '"\s*([^"]+?)\s*"', '"\1"', 'g'), chr(39) || '\s*([^' || chr(39) || ']+?)\s*' || chr(39), chr(39) || '\1' || chr(39), 'g') AS t FROM a),
c AS (SELECT file_id, page_number, text, replace(regexp_replace(regexp_replace(regexp_replace(t, '\(\s*', '(', 'g'), '\s*\)', ')', 'g'), '\s*-\s*', '-', 'g'), '--', '—') AS t FROM b)
SELECT file_id, page_number, t AS text, (t <> text)::bigint AS n_corrections FROM c

-- p7_final_cleanup
SELECT file_id, page_number, regexp_replace(array_to_string(list_transform(string_split_regex(regexp_replace(text, ' {2,}', ' ', 'g'), '\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM {p1_basic_cleanup}

-- repaired
SELECT o.file_id, o.page_number, o.text AS original, CASE WHEN regexp_matches(o.text, '(?im)^from:') THEN 'email' WHEN regexp_matches(o.text, '(?i)invoice\s*#') THEN 'invoice' WHEN regexp_matches(o.text, '(?i)\b(?:whereas|article)\b') THEN 'contract' END AS kind, coalesce(q.confidence < 0.6::double, false) AS unsure, c.text, c.n_corrections AS n FROM {ocr_pages} o
JOIN {p1_basic_cleanup} c ON o.file_id IS NOT DISTINCT FROM c.file_id AND o.page_number = c.page_number LEFT JOIN {q8_overall_confidence} q ON o.file_id IS NOT DISTINCT FROM q.file_id AND o.page_number = q.page_number

