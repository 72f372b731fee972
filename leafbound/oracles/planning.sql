-- o1_page_needs_ocr
SELECT file_id, page_number, CASE WHEN n > 50 THEN false WHEN image_share > 0.8::double THEN true ELSE false END AS needs_ocr, CASE WHEN n > 50 THEN 'has text' WHEN image_share > 0.8::double THEN 'image page' ELSE 'little content' END AS reason
FROM (SELECT file_id, page_number, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, cast(doc_id % 10 AS double) / 10 AS image_share FROM {pages_seeded})

-- o2_pdf_needs_ocr
SELECT file_id, count(*) AS sampled, (avg(CASE WHEN needs_ocr THEN 1::double ELSE 0::double END) >= 0.5::double) AS needs_ocr FROM (SELECT file_id, page_number, needs_ocr, count(*) OVER (PARTITION BY file_id) AS n FROM {o1_page_needs_ocr}) WHERE n <= 5 OR page_number - 1 IN (0, cast(floor(n / 5::double) AS int), cast(floor(2 * n / 5::double) AS int), cast(floor(3 * n / 5::double) AS int), cast(floor(4 * n / 5::double) AS int)) GROUP BY file_id

-- o3_sample_linspace
SELECT DISTINCT file_id, i, cast(floor(i * (n - 1) / 4::double) AS bigint) AS page_index FROM (SELECT file_id, n, unnest(generate_series(0, 4)) AS i FROM (SELECT file_id, count(*) AS n FROM {pages_doc} GROUP BY file_id) WHERE n > 5)

-- o4_ocr_page_limit
SELECT file_id, page_number, needs_ocr, (needs_ocr AND sum(CASE WHEN needs_ocr THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) <= 3) AS chosen FROM {o1_page_needs_ocr}

-- o5_analyze_document
SELECT file_id, count(*) AS total, count_if(t AND NOT i) AS text_pages, count_if(i AND NOT t) AS image_pages, count_if(t AND i) AS mixed_pages, count_if(NOT t AND NOT i) AS empty_pages,
  CASE WHEN count_if(i AND NOT t) > count(*) * 0.8::double THEN 'image-based' WHEN count_if(t AND NOT i) > count(*) * 0.8::double THEN 'text-based' ELSE 'mixed' END AS kind
FROM (SELECT file_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 50 AS t, has_images AS i FROM {pages_seeded}) GROUP BY file_id

-- o6_profile_document
SELECT p.file_id, count(*) AS pages, cast(sum(length(p.text)) AS bigint) AS n_chars, count_if(b.potential) AS potential, count_if(length(p.text) > 500) AS long_pages FROM {pages_seeded} p JOIN {t8_potential_boundary} b ON p.file_id IS NOT DISTINCT FROM b.file_id AND p.page_number = b.page_number GROUP BY p.file_id

-- o7_critical_pages
SELECT file_id, page_number, CASE WHEN potential THEN 'high' WHEN near OR n <= 10 THEN 'medium' WHEN length(text) > 500 AND NOT has_images THEN 'skip' ELSE 'fast' END AS strategy,
  CASE WHEN potential THEN 'potential_boundary' WHEN n <= 10 THEN 'small_document' WHEN near THEN 'boundary_context' WHEN length(text) > 500 AND NOT has_images THEN 'has_embedded_text' ELSE 'default' END AS reason
FROM (SELECT p.file_id, p.page_number, p.text, p.has_images, b.potential, c.medium AS near, count(*) OVER (PARTITION BY p.file_id) AS n FROM {pages_seeded} p JOIN {t8_potential_boundary} b ON p.file_id IS NOT DISTINCT FROM b.file_id AND p.page_number = b.page_number JOIN {w8_context_pages} c ON p.file_id IS NOT DISTINCT FROM c.file_id AND p.page_number = c.page_number)

-- o8_page_strategy
SELECT file_id, count_if(strategy = 'high') AS high, count_if(strategy = 'medium') AS medium, count_if(strategy = 'fast') AS fast, count_if(strategy = 'skip') AS skipped FROM {o7_critical_pages} GROUP BY file_id

-- o9_processing_order
SELECT file_id, page_number, strategy, cast(row_number() OVER (PARTITION BY file_id ORDER BY CASE strategy WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, page_number) AS bigint) AS position FROM {o7_critical_pages} WHERE strategy <> 'skip'

-- o10_estimated_time
SELECT file_id, round_even(sum(CASE strategy WHEN 'high' THEN 15::double WHEN 'medium' THEN 8::double WHEN 'fast' THEN 3::double WHEN 'skip' THEN 0.1::double ELSE 5::double END), 6) AS seconds FROM {o7_critical_pages} GROUP BY file_id

-- o11_adaptive_ocr_config
SELECT file_id, page_number, CASE WHEN high_quality OR llm THEN 'high' ELSE 'fast' END AS config FROM {w7_near_boundary}

-- o12_select_configuration
SELECT a.file_id, CASE WHEN h.construction THEN 'construction' WHEN a.scanned THEN 'high_accuracy' WHEN a.n > 100 THEN 'fast' WHEN a.tables AND a.images THEN 'high_accuracy' ELSE 'general' END AS preset, a.mean_words
FROM (SELECT file_id, count(*) AS n, round_even(avg(word_count), 6) AS mean_words, bool_or(has_tables) AS tables, bool_or(has_images) AS images, bool_or(word_count < 50 AND has_images) AS scanned FROM {pages_seeded} WHERE page_number <= 10 GROUP BY file_id) a JOIN {t10_type_hints} h ON a.file_id IS NOT DISTINCT FROM h.file_id

-- profiles
SELECT 'excellent' AS level, 0.85::double AS least, 150 AS dpi, 'deskew' AS steps, false AS gpu, 8 AS batch UNION ALL SELECT 'good' AS level, 0.7::double AS least, 200 AS dpi, 'deskew,contrast' AS steps, false AS gpu, 4 AS batch UNION ALL SELECT 'fair' AS level, 0.5::double AS least, 300 AS dpi, 'deskew,denoise,contrast' AS steps, true AS gpu, 2 AS batch UNION ALL SELECT 'poor' AS level, 0.3::double AS least, 300 AS dpi, 'upscale,denoise,deskew,contrast,threshold' AS steps, true AS gpu, 1 AS batch UNION ALL SELECT 'very_poor' AS level, 0.0::double AS least, 400 AS dpi, 'upscale,denoise,deskew,contrast,threshold,borders' AS steps, true AS gpu, 1 AS batch

-- file_quality
SELECT file_id, avg(coalesce(ocr_confidence, 0.5::double)) AS quality, cast(min(doc_id) % 4 AS double) AS skew, cast(max(doc_id) % 30 AS double) AS noise, count(*) AS pages, bool_or(has_tables) AS tables, min(doc_id) % 5 = 0 AS handwritten FROM {pages_seeded} GROUP BY file_id

-- o14_generate_config
SELECT q.file_id, p.level, p.dpi + CASE WHEN q.tables THEN 50 ELSE 0 END AS dpi, concat(p.steps, CASE WHEN q.skew > 1 AND NOT contains(p.steps, 'deskew') THEN ',deskew' ELSE '' END, CASE WHEN q.noise > 20 AND NOT contains(p.steps, 'denoise') THEN ',denoise' ELSE '' END) AS steps, CASE WHEN q.pages > 100 THEN p.batch * 2 ELSE p.batch END AS batch
FROM {file_quality} q JOIN (SELECT p.*, coalesce(lag(least) OVER (ORDER BY least DESC), 2::double) AS below FROM {profiles} p) p ON q.quality >= p.least AND q.quality < p.below

-- o15_engine_select
SELECT file_id, CASE WHEN handwritten OR quality < 0.3::double THEN 'easyocr' WHEN pages > 50 THEN 'tesseract-cli' ELSE 'easyocr' END AS engine FROM {file_quality}

-- o18_parallel_strategy
SELECT file_id, CASE WHEN count(*) < 10 THEN 'small' ELSE 'medium' END AS size, CASE WHEN count(*) < 10 THEN 2 ELSE 4 END AS workers, CASE WHEN count(*) < 10 THEN 2 ELSE 4 END AS batch FROM {pages_doc} GROUP BY file_id

-- o19_profiles
SELECT 'llm' AS profile, 250 AS dpi, 'easyocr' AS engine, 0.6::double AS threshold, 2 AS batch UNION ALL SELECT 'splitter' AS profile, 150 AS dpi, 'tesseract-cli' AS engine, 0.5::double AS threshold, 4 AS batch UNION ALL SELECT 'rag' AS profile, 300 AS dpi, 'easyocr' AS engine, 0.7::double AS threshold, 8 AS batch UNION ALL SELECT 'test' AS profile, 200 AS dpi, 'tesseract-cli' AS engine, 0.7::double AS threshold, 4 AS batch

-- modes
SELECT 'development' AS mode, 0.1::double AS temperature, 4096 AS max_tokens, 1000 AS page_chars, 3 AS context, 3 AS batch, 0.9::double AS llm_weight, 0.7::double AS rule_weight UNION ALL SELECT 'production' AS mode, 0.1::double AS temperature, 4096 AS max_tokens, 800 AS page_chars, 2 AS context, 5 AS batch, 0.85::double AS llm_weight, 0.8::double AS rule_weight UNION ALL SELECT 'high_perf' AS mode, 0.2::double AS temperature, 2048 AS max_tokens, 500 AS page_chars, 1 AS context, 10 AS batch, 0.8::double AS llm_weight, 0.9::double AS rule_weight UNION ALL SELECT 'high_accuracy' AS mode, 0.05::double AS temperature, 6144 AS max_tokens, 1200 AS page_chars, 4 AS context, 2 AS batch, 0.95::double AS llm_weight, 0.6::double AS rule_weight UNION ALL SELECT 'low_resource' AS mode, 0.3::double AS temperature, 1024 AS max_tokens, 300 AS page_chars, 1 AS context, 15 AS batch, 0.7::double AS llm_weight, 1.0::double AS rule_weight

-- o20_deployment_presets
SELECT mode, focus, temperature, max_tokens, CASE WHEN focus THEN least(1200, page_chars + 200) ELSE page_chars END AS page_chars, CASE WHEN focus THEN least(4, context + 1) ELSE context END AS context, batch, llm_weight, rule_weight FROM (SELECT m.*, unnest(list_value(true, false)) AS focus FROM {modes} m)

-- o21_detector_presets
SELECT 'construction' AS preset, 1.5::double AS construction, 1.0::double AS rule, 0.7::double AS llm, 0.0::double AS vlm, 0.6::double AS min_confidence, 1 AS min_signals UNION ALL SELECT 'general' AS preset, 0.8::double AS construction, 1.0::double AS rule, 1.0::double AS llm, 0.0::double AS vlm, 0.6::double AS min_confidence, 1 AS min_signals UNION ALL SELECT 'high_accuracy' AS preset, 1.2::double AS construction, 1.0::double AS rule, 1.1::double AS llm, 0.9::double AS vlm, 0.7::double AS min_confidence, 2 AS min_signals UNION ALL SELECT 'fast' AS preset, 1.0::double AS construction, 1.0::double AS rule, 0.0::double AS llm, 0.0::double AS vlm, 0.5::double AS min_confidence, 1 AS min_signals UNION ALL SELECT 'llm_only' AS preset, 0.0::double AS construction, 0.0::double AS rule, 1.0::double AS llm, 0.0::double AS vlm, 0.6::double AS min_confidence, 1 AS min_signals

-- o22_indicator_pages
SELECT file_id, count_if((contains(lower(text), 'from:') OR contains(lower(text), 'to:') OR contains(lower(text), 'subject:') OR contains(lower(text), 'invoice') OR contains(lower(text), 'bill') OR contains(lower(text), 'statement') OR contains(lower(text), 'page 1') OR contains(lower(text), 'page 1 of') OR contains(lower(text), 'dear') OR contains(lower(text), 'sincerely') OR contains(lower(text), 'contract') OR contains(lower(text), 'agreement'))) AS n FROM {pages_seeded} GROUP BY file_id

-- waiting_tasks
SELECT task_id, priority, CASE priority WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END AS rank, ts, ((year(ts) * 100 + month(ts)) * 100 + day(ts)) * 100 + hour(ts) AS hour FROM {tasks} WHERE status = 'pending'

-- rank_hours
SELECT h.rank, h.hour, t.before + h.before AS before FROM (SELECT rank, hour, sum(n) OVER (PARTITION BY rank ORDER BY hour ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT rank, hour, count(*) AS n FROM {waiting_tasks} GROUP BY rank, hour)) h
JOIN (SELECT rank, sum(n) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT rank, count(*) AS n FROM {waiting_tasks} GROUP BY rank)) t ON h.rank IS NOT DISTINCT FROM t.rank

-- spelled_hours
SELECT h.priority, h.hour, t.before + h.before AS before FROM (SELECT priority, hour, sum(n) OVER (PARTITION BY priority ORDER BY hour ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT priority, hour, count(*) AS n FROM {waiting_tasks} GROUP BY priority, hour)) h
JOIN (SELECT priority, sum(n) OVER (ORDER BY priority ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT priority, count(*) AS n FROM {waiting_tasks} GROUP BY priority)) t ON h.priority IS NOT DISTINCT FROM t.priority

-- task_queue_order
SELECT w.task_id, w.priority, cast(r.before + w.n AS bigint) AS position, cast(s.before + w.m AS bigint) AS spelled_position
FROM (SELECT task_id, priority, rank, hour, row_number() OVER (PARTITION BY rank, hour ORDER BY ts, task_id) AS n, row_number() OVER (PARTITION BY priority, hour ORDER BY ts, task_id) AS m FROM {waiting_tasks}) w
JOIN {rank_hours} r ON w.rank = r.rank AND w.hour IS NOT DISTINCT FROM r.hour JOIN {spelled_hours} s ON w.priority IS NOT DISTINCT FROM s.priority AND w.hour IS NOT DISTINCT FROM s.hour

-- task_status
SELECT user_id, status, n_events FROM (SELECT user_id, status, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, task_id DESC) AS r FROM {tasks}) WHERE r = 1

