-- clustered
SELECT file_id, page_number, b, x, sum(starts) OVER (PARTITION BY file_id, page_number ORDER BY x, b ROWS UNBOUNDED PRECEDING) AS cluster
FROM (SELECT file_id, page_number, b, x, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY file_id, page_number ORDER BY x, b) > 50, true) THEN 1 ELSE 0 END AS starts FROM {blocks} WHERE kind = 'text')

-- g1_cluster_positions
SELECT file_id, page_number, cast(cluster AS bigint) AS cluster, count(*) AS n, min(x) AS from_x, max(x) AS to_x FROM {clustered} GROUP BY file_id, page_number, cluster

-- g2_num_columns
SELECT p.file_id, p.page_number, cast(coalesce(max(c.cluster), 1) AS bigint) AS num_columns FROM {pages_doc} p LEFT JOIN {clustered} c ON p.file_id IS NOT DISTINCT FROM c.file_id AND p.page_number = c.page_number GROUP BY p.file_id, p.page_number

-- g3_layout_type
SELECT p.file_id, p.page_number, CASE WHEN max(c.cluster) IS NULL THEN 'empty' WHEN max(c.cluster) = 1 THEN 'single_column' WHEN max(c.cluster) = 2 THEN 'two_column' ELSE 'multi_column' END AS layout_type
FROM {pages_doc} p LEFT JOIN {clustered} c ON p.file_id IS NOT DISTINCT FROM c.file_id AND p.page_number = c.page_number GROUP BY p.file_id, p.page_number

-- g4_header_footer
SELECT file_id, page_number, bool_or(y < 79.2::double) AS has_header, bool_or(y + h > 712.8::double) AS has_footer, array_to_string(list_sort(list_filter(list(CASE WHEN y < 79.2::double THEN block_text END), lambda s: s IS NOT NULL)), ' ') AS header_text,
  array_to_string(list_sort(list_filter(list(CASE WHEN y + h > 712.8::double THEN block_text END), lambda s: s IS NOT NULL)), ' ') AS footer_text FROM {blocks} GROUP BY file_id, page_number

-- g5_whitespace_ratio
SELECT file_id, page_number, round_even(1 - sum(w * h) / (612::double * 792::double), 6) AS ratio FROM {blocks} GROUP BY file_id, page_number

-- g6_visual_signature
SELECT file_id, page_number, count_if(kind = 'text') / 100::double AS texts, count_if(kind IN ('picture', 'figure')) / 10::double AS images, count_if(kind = 'table') / 5::double AS tables, round_even(avg(x / 612), 6) AS mean_x, round_even(avg(y / 792), 6) AS mean_y,
  round_even(stddev_pop(x / 612), 6) AS std_x, round_even(stddev_pop(y / 792), 6) AS std_y, round_even(avg(w / 612), 6) AS mean_w, round_even(avg(h / 792), 6) AS mean_h FROM {blocks} GROUP BY file_id, page_number

-- g7_cosine
SELECT vec_id, round_even(CASE WHEN ne = 0 OR np = 0 THEN 0::double ELSE dot / (sqrt(ne) * sqrt(np)) END, 6) AS cosine FROM (SELECT vec_id, coalesce(list_sum(list_transform(list_zip(e, pe), lambda p: p[1] * p[2])), 0) AS dot, coalesce(list_sum(list_transform(list_zip(e, e), lambda p: p[1] * p[1])), 0) AS ne, coalesce(list_sum(list_transform(list_zip(pe, pe), lambda p: p[1] * p[1])), 0) AS np
FROM (SELECT vec_id, e, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS pe FROM (SELECT label, vec_id, list_transform(embedding, lambda v: cast(v AS double)) AS e FROM {embeddings})) WHERE pe IS NOT NULL)

-- g8_classify_blocks
SELECT file_id, page_number, b, CASE WHEN contains(kind, 'text') OR contains(kind, 'paragraph') THEN 'text' WHEN contains(kind, 'image') OR contains(kind, 'figure') OR contains(kind, 'picture') THEN 'image' WHEN contains(kind, 'table') THEN 'table' END AS class FROM {blocks} WHERE w > 0 AND h > 0

-- g9_primary_font
SELECT s.file_id, s.page_number, s.font_size, f.font_family FROM (SELECT file_id, page_number, font_size, row_number() OVER (PARTITION BY file_id, page_number ORDER BY count(*) DESC, font_size) AS r FROM {blocks} GROUP BY file_id, page_number, font_size) s
JOIN (SELECT file_id, page_number, font_family, row_number() OVER (PARTITION BY file_id, page_number ORDER BY count(*) DESC, font_family) AS r FROM {blocks} GROUP BY file_id, page_number, font_family) f ON s.file_id IS NOT DISTINCT FROM f.file_id AND s.page_number = f.page_number AND s.r = 1 AND f.r = 1

-- g10_count_elements
SELECT file_id, page_number, count_if(kind IN ('picture', 'image', 'figure')) AS images, count_if(contains(kind, 'chart')) AS charts, count_if(kind = 'table') AS tables FROM {blocks} GROUP BY file_id, page_number

-- g12_orientation
SELECT file_id, page_number, CASE WHEN aspect > 1.2::double THEN 'landscape' ELSE 'portrait' END AS orientation FROM {visual}

-- g13_constants
SELECT file_id, page_number, 'left' AS alignment, cast(NULL AS string) AS picture_classes, cast(NULL AS string) AS vlm_analysis FROM {pages_doc}

