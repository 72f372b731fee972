-- s4_bytes_source
SELECT file_id, page_number, cast(length(text) AS bigint) AS n_chars, md5(text) AS checksum FROM {pages_doc}

-- s8_upload_sink
SELECT page_id, url, CASE WHEN NOT contains(lower(url), '.') THEN 'no name' WHEN size_mb > 500 THEN 'too large' WHEN page_id % 3 = 2 THEN 'not a PDF' ELSE 'accepted' END AS verdict FROM (SELECT page_id, url, page_id * 37 % 800 AS size_mb FROM {pages})

-- s9_split_sink
SELECT file_id, name, concat(file_id, '/', name, '.pdf') AS path, page_count FROM {b20_split_naming}

-- s10_rag_export
SELECT b.file_id, b.start_page, to_json({'file': b.file_id, 'type': coalesce(b.document_type, 'unknown'), 'confidence': round_even(b.confidence, 6), 'start_page': b.start_page, 'end_page': b.end_page,
  'pages': list({'page': p.page_number, 'preview': left(p.text, 200), 'word_count': p.word_count, 'confidence': p.ocr_confidence} ORDER BY p.page_number)})::varchar AS json, sum(length(left(p.text, 200)))::bigint AS preview_chars, sum(p.word_count)::bigint AS word_count
FROM {b4_segment_pages} b JOIN {pages_seeded} p ON p.file_id IS NOT DISTINCT FROM b.file_id AND p.page_number BETWEEN b.start_page AND b.end_page WHERE p.text <> '' GROUP BY b.file_id, b.start_page, b.end_page, b.confidence, b.document_type

-- s11_delete
SELECT file_id, page_number FROM {pages_doc} WHERE coalesce(file_id NOT IN ('src1', 'src3'), true)

