-- ocr_pages
SELECT file_id, page_number, doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'xx' END AS expected, concat(CASE doc_id % 8 WHEN 0 THEN concat('From: a @ grnail . com', chr(10), 'To: c@d.org', chr(10), 'Subject: rn tl1e thec ~~~ ', chr(10)) WHEN 1 THEN concat('lnvoice ||| INVOICE # 77 total $ 1,200.50 due 2024-03-05 @@@', chr(10))
  WHEN 2 THEN 'th e cl vv O l 1 and t o work ( now ) , "  quoted  " well-' WHEN 3 THEN concat('section 4 ARTICLE 5 whereas party shall', chr(10), chr(10), chr(10), chr(10), chr(10), 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx   #### ##### ----', chr(10)) WHEN 4 THEN 'end.Next,then;so   I1 11 Il ____ ' ELSE '' END,
  text) AS text FROM {pages_doc}

-- char_counts
SELECT file_id, page_number, doc_id, expected, text, length(text) AS n, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '\p{Nd}', '', 'g')) AS digits, length(text) - length(regexp_replace(text, '[ \t\n\r\f\x0B\x1c-\x1f\x85\xa0]', '', 'g')) AS spaces,
  length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS marks, len(regexp_extract_all(text, '[\x01-\x08\x0B\x0C\x0E-\x1F]', 0)) + len(regexp_extract_all(text, '[|]{3,}', 0)) + len(regexp_extract_all(text, '[~]{3,}', 0)) + len(regexp_extract_all(text, '[#]{5,}', 0)) + len(regexp_extract_all(text, '[@]{3,}', 0)) AS suspicious FROM {ocr_pages}

-- q1_char_confidence
SELECT file_id, page_number, CASE WHEN n = 0 THEN 0::double ELSE greatest(0::double, CASE WHEN letters / cast(n AS double) BETWEEN 0.6::double AND 0.85::double THEN least(1::double, c + 0.1::double) ELSE c END) END AS confidence
FROM (SELECT file_id, page_number, n, letters, CASE WHEN n = 0 THEN 0::double ELSE 1 - CASE WHEN (n - letters - digits - spaces - marks) / cast(n AS double) > 0.1::double THEN least((n - letters - digits - spaces - marks) / cast(n AS double) * 2, 0.5::double) ELSE 0::double END - CASE WHEN suspicious > 0 THEN least(suspicious / cast(n AS double) * 10, 0.5::double) ELSE 0::double END END AS c FROM {char_counts})

-- page_words
SELECT file_id, page_number, expected, text, words, list_sort(words) AS sorted, len(words) AS n FROM (SELECT file_id, page_number, expected, text, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0), lambda w: regexp_matches(w, '^[a-z]+$')) AS words FROM {ocr_pages})

-- word_counts
SELECT file_id, page_number, expected, text, n, len(list_filter(words, lambda w: w IN ('a', 'about', 'after', 'all', 'also', 'an', 'and', 'any', 'are', 'as', 'at', 'back', 'be', 'because', 'been', 'but', 'by', 'can', 'come', 'could', 'day', 'do', 'each', 'even', 'first', 'for', 'from', 'get', 'give', 'go', 'good', 'had', 'has', 'have', 'he', 'her', 'him', 'his', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'just', 'know', 'like', 'long', 'look', 'make', 'many', 'me', 'more', 'most', 'my', 'new', 'no', 'not', 'now', 'of', 'on', 'one', 'only', 'or', 'other', 'our', 'out', 'over', 'people', 'said', 'say', 'see', 'she', 'so', 'some', 'take', 'than', 'that', 'the', 'their', 'them', 'then', 'there', 'these', 'they', 'thing', 'think', 'this', 'time', 'to', 'two', 'up', 'us', 'use', 'want', 'was', 'way', 'we', 'well', 'were', 'what', 'when', 'which', 'who', 'will', 'with', 'work', 'would', 'write', 'year', 'you', 'your'))) AS common, len(list_filter(words, lambda w: w NOT IN ('a', 'about', 'after', 'all', 'also', 'an', 'and', 'any', 'are', 'as', 'at', 'back', 'be', 'because', 'been', 'but', 'by', 'can', 'come', 'could', 'day', 'do', 'each', 'even', 'first', 'for', 'from', 'get', 'give', 'go', 'good', 'had', 'has', 'have', 'he', 'her', 'him', 'his', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'just', 'know', 'like', 'long', 'look', 'make', 'many', 'me', 'more', 'most', 'my', 'new', 'no', 'not', 'now', 'of', 'on', 'one', 'only', 'or', 'other', 'our', 'out', 'over', 'people', 'said', 'say', 'see', 'she', 'so', 'some', 'take', 'than', 'that', 'the', 'their', 'them', 'then', 'there', 'these', 'they', 'thing', 'think', 'this', 'time', 'to', 'two', 'up', 'us', 'use', 'want', 'was', 'way', 'we', 'well', 'were', 'what', 'when', 'which', 'who', 'will', 'with', 'work', 'would', 'write', 'year', 'you', 'your') AND length(w) BETWEEN 2 AND 15)) AS fair, len(list_filter(words, lambda w: w NOT IN ('a', 'about', 'after', 'all', 'also', 'an', 'and', 'any', 'are', 'as', 'at', 'back', 'be', 'because', 'been', 'but', 'by', 'can', 'come', 'could', 'day', 'do', 'each', 'even', 'first', 'for', 'from', 'get', 'give', 'go', 'good', 'had', 'has', 'have', 'he', 'her', 'him', 'his', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'just', 'know', 'like', 'long', 'look', 'make', 'many', 'me', 'more', 'most', 'my', 'new', 'no', 'not', 'now', 'of', 'on', 'one', 'only', 'or', 'other', 'our', 'out', 'over', 'people', 'said', 'say', 'see', 'she', 'so', 'some', 'take', 'than', 'that', 'the', 'their', 'them', 'then', 'there', 'these', 'they', 'thing', 'think', 'this', 'time', 'to', 'two', 'up', 'us', 'use', 'want', 'was', 'way', 'we', 'well', 'were', 'what', 'when', 'which', 'who', 'will', 'with', 'work', 'would', 'write', 'year', 'you', 'your') AND length(w) > 20)) AS long,
  len(list_filter(words, lambda w: (length(w) > 5 AND (regexp_matches(w, '[bcdfghjklmnpqrstvwxyz]{4,}') OR regexp_matches(w, 'aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz') OR (length(w) - length(regexp_replace(w, '[aeiou]', '', 'g'))) / cast(length(w) AS double) < 0.2::double)))) AS gibberish, CASE WHEN n = 0 THEN false ELSE len(list_filter(generate_series(1, n - cast(floor(n / 5::double) AS int)), lambda i: list_extract(sorted, i) = list_extract(sorted, i + cast(floor(n / 5::double) AS int)))) > 0 END AS repetitive FROM {page_words}

-- q2_word_confidence
SELECT file_id, page_number, round_even(CASE WHEN n = 0 THEN 0::double ELSE least(1::double, (common + 0.3::double * fair - 0.2::double * long) / n * CASE WHEN gibberish > n * 0.1::double THEN 0.8::double ELSE 1::double END * CASE WHEN repetitive THEN 0.7::double ELSE 1::double END) END, 9) AS confidence FROM {word_counts}

-- q3_gibberish
SELECT file_id, page_number, cast(gibberish AS bigint) AS gibberish, cast(n AS bigint) AS n_words FROM {word_counts}

-- structure
SELECT file_id, page_number, text, len(sentences) AS n_sentences, len(list_filter(sentences, lambda s: regexp_matches(s, '^\s*\p{Lu}'))) AS capital, len(list_filter(sentences, lambda s: len(regexp_extract_all(s, '[^\s]+', 0)) BETWEEN 3 AND 50)) AS fair,
  contains(text, '   ') AS wide, len(regexp_extract_all(text, '[.!?,][a-zA-Z]', 0)) AS tight, len(list_filter(lines, lambda s: NOT regexp_matches(s, '[^\s]'))) AS blank, len(lines) AS n_lines
FROM (SELECT file_id, page_number, text, string_split_regex(text, '[.!?]+') AS sentences, string_split_regex(text, '\n') AS lines FROM {ocr_pages})

-- q4_structure_confidence
SELECT file_id, page_number, round_even(CASE WHEN text = '' THEN 0::double ELSE (least((0.3::double * capital + 0.7::double * fair) / n_sentences, 1::double) + 1 - CASE WHEN wide THEN 0.2::double ELSE 0::double END - CASE WHEN tight > 5 THEN 0.3::double ELSE 0::double END + CASE WHEN blank / cast(n_lines AS double) > 0.5::double THEN 0.5::double ELSE 1::double END) / 3 END, 9) AS confidence FROM {structure}

-- language
SELECT file_id, page_number, expected, n, common, len(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])the\s+[\p{L}\p{N}_]', 0)) + len(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])and\s+[\p{L}\p{N}_]', 0)) + len(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])of\s+[\p{L}\p{N}_]', 0)) + len(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])to\s+[\p{L}\p{N}_]', 0)) + len(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])in\s+[\p{L}\p{N}_]', 0)) + len(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])is\s+[\p{L}\p{N}_]', 0)) + len(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])was\s+[\p{L}\p{N}_]', 0)) AS pairs FROM {word_counts}

-- q5_language_confidence
SELECT file_id, page_number, round_even(CASE WHEN expected <> 'en' THEN 0.5::double WHEN n = 0 THEN 0::double WHEN pairs > 0 THEN (common / cast(n AS double) + least(pairs / 20::double, 1::double)) / 2 ELSE common / cast(n AS double) END, 9) AS confidence FROM {language}

-- q6_pattern_confidence
SELECT file_id, page_number, CASE WHEN emails > 0 THEN 1::double END AS email, CASE WHEN dates > 0 THEN least(dates / 5::double, 1::double) END AS dates, CASE WHEN amounts > 0 THEN least(amounts / 3::double, 1::double) END AS currency
FROM (SELECT file_id, page_number, len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0)) AS emails, len(regexp_extract_all(text, '\d{1,2}/\d{1,2}/\d{2,4}', 0)) + len(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}', 0)) + len(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}', 0)) AS dates, len(regexp_extract_all(text, '[$€£¥]\s*\d+[,.\d]*', 0)) AS amounts FROM {ocr_pages})

-- q7_document_confidence
SELECT file_id, page_number, round_even((cast(regexp_matches(text, '(?im)^from:') AS int) + cast(regexp_matches(text, '(?im)^to:') AS int) + cast(regexp_matches(text, '(?im)^subject:') AS int) + cast(regexp_matches(text, '(?im)^date:') AS int)) / 4::double / 3 + least(len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0)) / 2::double, 1::double) / 3 + least((cast(contains(lower(text), 'dear') AS int) + cast(contains(lower(text), 'regards') AS int) + cast(contains(lower(text), 'sincerely') AS int) + cast(contains(lower(text), 'thank you') AS int) + cast(contains(lower(text), 'please') AS int) + cast(contains(lower(text), 'attached') AS int)) / 3::double, 1::double) / 3, 9) AS email,
  round_even((least((cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:invoice)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:bill)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:total)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:amount)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:payment)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:due)([^a-z0-9_]|$)') AS int)) / 3::double, 1::double) + least(len(regexp_extract_all(text, '[$€£¥]\s*[\d,]+\.?\d*', 0)) / 3::double, 1::double) + CASE WHEN regexp_matches(text, '(?i)invoice\s*#?\s*:?\s*\d+') THEN 1::double ELSE 0::double END) / 3, 9) AS invoice,
  round_even((least((cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:agreement)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:party)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:parties)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:whereas)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:therefore)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:shall)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:hereby)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:terms)([^a-z0-9_]|$)') AS int) + cast(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:conditions)([^a-z0-9_]|$)') AS int)) / 4::double, 1::double) + least(len(regexp_extract_all(text, '(?i)(?:section|article|clause)\s+\d+', 0)) / 3::double, 1::double)) / 2, 9) AS contract, 0.5::double AS other FROM {ocr_pages}

-- page_scores
SELECT c.file_id, c.page_number, c.confidence AS chars, w.confidence AS words, s.confidence AS structure, l.confidence AS language FROM {q1_char_confidence} c JOIN {q2_word_confidence} w ON c.file_id IS NOT DISTINCT FROM w.file_id AND c.page_number = w.page_number
JOIN {q4_structure_confidence} s ON c.file_id IS NOT DISTINCT FROM s.file_id AND c.page_number = s.page_number JOIN {q5_language_confidence} l ON c.file_id IS NOT DISTINCT FROM l.file_id AND c.page_number = l.page_number

-- page_quality
SELECT p.file_id, p.page_number, p.text, s.chars, s.words, s.structure, s.language, CASE WHEN p.text = '' THEN 0::double ELSE 0.25::double * s.chars + 0.3::double * s.words + 0.2::double * s.structure + 0.25::double * s.language END AS overall,
  CASE WHEN p.text = '' THEN list_value('no_text_detected') ELSE list_filter(list_value(CASE WHEN s.chars < 0.7::double THEN 'suspicious_characters' END, CASE WHEN s.words < 0.6::double THEN 'low_word_recognition' END, CASE WHEN s.structure < 0.6::double THEN 'poor_text_structure' END, CASE WHEN s.language < 0.5::double THEN 'language_detection_failed' END,
    CASE WHEN regexp_matches(p.text, '[|~#@]{3,}') THEN 'ocr_artifacts_detected' END, CASE WHEN regexp_matches(p.text, '[\p{L}\p{N}_]{25,}') THEN 'word_boundary_errors' END, CASE WHEN len(regexp_extract_all(p.text, '\n\n\n', 0)) > 3 THEN 'excessive_line_breaks' END, CASE WHEN regexp_matches(p.text, '(^|[^\p{L}\p{N}_])rn([^\p{L}\p{N}_]|$)') THEN 'rn_to_m_errors' END,
    CASE WHEN regexp_matches(p.text, '(^|[^\p{L}\p{N}_])[0O]([^\p{L}\p{N}_]|$)') THEN 'zero_o_confusion' END, CASE WHEN regexp_matches(p.text, '(^|[^\p{L}\p{N}_])[Il1]{2,}([^\p{L}\p{N}_]|$)') THEN 'i_l_1_confusion' END), lambda x: x IS NOT NULL) END AS issues
FROM {ocr_pages} p JOIN {page_scores} s ON p.file_id IS NOT DISTINCT FROM s.file_id AND p.page_number = s.page_number

-- q8_overall_confidence
SELECT file_id, page_number, round_even(overall, 6) AS confidence FROM {page_quality}

-- q9_quality_bucket
SELECT file_id, page_number, CASE WHEN text = '' THEN 'empty' WHEN overall >= 0.9::double THEN 'excellent' WHEN overall >= 0.8::double THEN 'good' WHEN overall >= 0.6::double THEN 'fair' WHEN overall >= 0.4::double THEN 'poor' ELSE 'very_poor' END AS quality FROM {page_quality}

-- q10_issues
SELECT file_id, page_number, array_to_string(issues, ',') AS issues FROM {page_quality}

-- q11_suggestions
SELECT file_id, page_number, array_to_string(list_filter(list_value(CASE WHEN list_contains(issues, 'suspicious_characters') THEN 'improve scan quality' END, CASE WHEN list_contains(issues, 'low_word_recognition') THEN 'check language settings' END, CASE WHEN list_contains(issues, 'poor_text_structure') THEN 'adjust layout analysis' END,
  CASE WHEN list_contains(issues, 'ocr_artifacts_detected') THEN 'apply preprocessing' END, CASE WHEN list_contains(issues, 'word_boundary_errors') THEN 'adjust word segmentation' END, 'manual review'), lambda x: x IS NOT NULL), '; ') AS suggestions FROM {page_quality}

-- q12_metrics
SELECT file_id, page_number, cast(length(text) AS bigint) AS n_chars, cast(len(w) AS bigint) AS n_words, cast(len(string_split_regex(text, '\n')) AS bigint) AS n_lines, cast(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS bigint) AS n_distinct, CASE WHEN len(w) > 0 THEN round_even(length(array_to_string(w, '')) / cast(len(w) AS double), 6) END AS mean_length
FROM (SELECT file_id, page_number, text, regexp_extract_all(text, '[^ \t\n\r\f]+', 0) AS w FROM {ocr_pages})

-- q13_quality_summary
SELECT file_id, round_even(avg(overall), 6) AS mean_confidence, count_if(overall > 0 AND overall < 0.7::double) AS n_review, array_to_string(list_transform(list_sort(list_filter(list(CASE WHEN overall > 0 AND overall < 0.7::double THEN page_number END), lambda x: x IS NOT NULL)), lambda x: cast(x AS string)), ',') AS review, cast(sum(len(issues)) AS bigint) AS n_issues FROM {page_quality} GROUP BY file_id

-- q14_page_report
SELECT file_id, page_number, round_even(chars, 6) AS chars, round_even(words, 6) AS words, round_even(structure, 6) AS structure, round_even(language, 6) AS language, CASE WHEN text = '' THEN 'empty' WHEN overall >= 0.9::double THEN 'excellent' WHEN overall >= 0.8::double THEN 'good' WHEN overall >= 0.6::double THEN 'fair' WHEN overall >= 0.4::double THEN 'poor' ELSE 'very_poor' END AS quality FROM {page_quality} WHERE page_number = 3

-- q15_enhance_page
SELECT file_id, page_number, (text <> '' AND overall < 0.6::double) AS repair, CASE WHEN overall < 0.4::double THEN 'aggressive' WHEN overall < 0.6::double THEN 'normal' ELSE 'none' END AS mode FROM {page_quality}

-- q16_processing_stats
SELECT count(*) AS pages, count_if(text <> '') AS read, count_if(overall < 0.6::double) AS low, round_even(avg(overall), 6) AS mean_confidence FROM {page_quality}

-- q17_validators
SELECT file_id, page_number, cast(len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0)) AS bigint) AS emails, cast(len(regexp_extract_all(text, 'https?://(?:www\.)?[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0)) AS bigint) AS urls, cast(len(regexp_extract_all(text, '[\+\(]?[1-9][0-9 .\-\(\)]{8,}[0-9]', 0)) AS bigint) AS phones, cast(len(regexp_extract_all(text, '\d{1,2}/\d{1,2}/\d{2,4}', 0)) + len(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}', 0)) + len(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}', 0)) AS bigint) AS dates, cast(len(regexp_extract_all(text, '[$€£¥]\s*\d+[,.\d]*', 0)) AS bigint) AS amounts, cast(len(regexp_extract_all(text, '\d+\.?\d*\s*%', 0)) AS bigint) AS percentages FROM {ocr_pages}

