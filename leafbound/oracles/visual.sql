-- visual_pairs
SELECT file_id, page_number, width, height, n_separators, text, num_columns AS c_num_columns, lag(num_columns) OVER w AS p_num_columns, font_size AS c_font_size, lag(font_size) OVER w AS p_font_size, font_family AS c_font_family, lag(font_family) OVER w AS p_font_family, alignment AS c_alignment, lag(alignment) OVER w AS p_alignment, background AS c_background, lag(background) OVER w AS p_background, ink AS c_ink, lag(ink) OVER w AS p_ink, color_images AS c_color_images, lag(color_images) OVER w AS p_color_images, has_header AS c_has_header, lag(has_header) OVER w AS p_has_header, has_footer AS c_has_footer, lag(has_footer) OVER w AS p_has_footer, header_text AS c_header_text, lag(header_text) OVER w AS p_header_text, footer_text AS c_footer_text, lag(footer_text) OVER w AS p_footer_text, num_tables AS c_num_tables, lag(num_tables) OVER w AS p_num_tables, num_images AS c_num_images, lag(num_images) OVER w AS p_num_images, has_logo AS c_has_logo, lag(has_logo) OVER w AS p_has_logo, has_signature AS c_has_signature, lag(has_signature) OVER w AS p_has_signature, margin_top AS c_margin_top, lag(margin_top) OVER w AS p_margin_top, margin_bottom AS c_margin_bottom, lag(margin_bottom) OVER w AS p_margin_bottom, margin_left AS c_margin_left, lag(margin_left) OVER w AS p_margin_left, margin_right AS c_margin_right, lag(margin_right) OVER w AS p_margin_right, orientation AS c_orientation, lag(orientation) OVER w AS p_orientation, aspect AS c_aspect, lag(aspect) OVER w AS p_aspect, word_count AS c_word_count, lag(word_count) OVER w AS p_word_count, boundary_score AS c_boundary_score, lag(boundary_score) OVER w AS p_boundary_score, lag(page_number) OVER w AS p_page FROM {visual} WINDOW w AS (PARTITION BY file_id ORDER BY page_number)

-- w9_layout_structure
SELECT file_id, page_number, CASE WHEN n > 0 THEN least(0.8::double, 0.3::double * n) END AS confidence FROM (SELECT file_id, page_number,
  cast(coalesce(c_num_columns <> p_num_columns, false) AS int) + cast(coalesce(c_alignment <> p_alignment, false) AS int) + cast(coalesce((c_num_tables > 0) <> (p_num_tables > 0), false) AS int) AS n FROM {visual_pairs} WHERE p_page IS NOT NULL)

-- w10_font_change
SELECT file_id, page_number, CASE WHEN c_font_size IS NULL OR p_font_size IS NULL THEN NULL WHEN coalesce(c_font_family <> p_font_family, false) THEN 0.7::double WHEN abs(c_font_size - p_font_size) > 2 THEN 0.6::double END AS confidence FROM {visual_pairs} WHERE p_page IS NOT NULL

-- w11_color_change
SELECT file_id, page_number, CASE WHEN cast(coalesce(c_background <> p_background, false) AS int) + cast(coalesce(c_ink <> p_ink, false) AS int) + cast(coalesce(c_color_images <> p_color_images, false) AS int) >= 2 THEN 0.6::double END AS confidence FROM {visual_pairs} WHERE p_page IS NOT NULL

-- w12_margin_change
SELECT file_id, page_number, CASE WHEN c_margin_top IS NOT NULL AND c_margin_top <> 0 AND p_margin_top IS NOT NULL AND p_margin_top <> 0 AND c_margin_bottom IS NOT NULL AND c_margin_bottom <> 0 AND p_margin_bottom IS NOT NULL AND p_margin_bottom <> 0 AND c_margin_left IS NOT NULL AND c_margin_left <> 0 AND p_margin_left IS NOT NULL AND p_margin_left <> 0 AND c_margin_right IS NOT NULL AND c_margin_right <> 0 AND p_margin_right IS NOT NULL AND p_margin_right <> 0 AND cast(coalesce(abs(c_margin_top - p_margin_top) > 20, false) AS int) + cast(coalesce(abs(c_margin_bottom - p_margin_bottom) > 20, false) AS int) + cast(coalesce(abs(c_margin_left - p_margin_left) > 20, false) AS int) + cast(coalesce(abs(c_margin_right - p_margin_right) > 20, false) AS int) >= 2 THEN 0.65::double END AS confidence FROM {visual_pairs} WHERE p_page IS NOT NULL

-- w13_header_footer_change
SELECT file_id, page_number, CASE WHEN n > 0 THEN least(0.75::double, 0.25::double * n) END AS confidence FROM (SELECT file_id, page_number, cast(coalesce(c_has_header <> p_has_header, false) AS int) + cast(coalesce(c_has_footer <> p_has_footer, false) AS int)
  + cast(coalesce(c_has_header AND p_has_header AND c_header_text <> p_header_text, false) AS int) + cast(coalesce(c_has_footer AND p_has_footer AND c_footer_text <> p_footer_text, false) AS int) AS n FROM {visual_pairs} WHERE p_page IS NOT NULL)

-- w14_visual_separator
SELECT file_id, page_number, cast(sum(CASE WHEN w / greatest(h, 1::double) > 50 AND h < 5 OR block_text IN ('---', '___', '***', '• • •', '···') THEN 1 ELSE 0 END) AS bigint) AS n,
  CASE WHEN sum(CASE WHEN w / greatest(h, 1::double) > 50 AND h < 5 OR block_text IN ('---', '___', '***', '• • •', '···') THEN 1 ELSE 0 END) > 0 THEN 0.9::double END AS confidence FROM {blocks} GROUP BY file_id, page_number

-- w15_logo
SELECT file_id, page_number, CASE WHEN has_logo THEN 0.85::double END AS confidence FROM {visual}

-- w16_signature
SELECT file_id, p_page AS signal_page, page_number, CASE WHEN p_has_signature THEN 0.8::double END AS confidence FROM {visual_pairs} WHERE p_page IS NOT NULL

-- w17_orientation
SELECT file_id, page_number, CASE WHEN c_orientation <> p_orientation THEN 0.95::double END AS confidence FROM {visual_pairs} WHERE p_page IS NOT NULL

-- w18_column_change
SELECT file_id, page_number, CASE WHEN c_num_columns <> p_num_columns AND (c_num_columns = 1 OR p_num_columns = 1 OR abs(c_num_columns - p_num_columns) > 1) THEN 0.7::double END AS confidence FROM {visual_pairs} WHERE p_page IS NOT NULL

-- w19_whitespace_pattern
SELECT file_id, page_number, CASE WHEN r > 0.7::double OR c_word_count < 20 THEN 0.5::double + 0.3::double * r END AS confidence FROM (SELECT file_id, page_number, c_word_count,
  CASE WHEN c_word_count < 50 AND c_margin_top IS NOT NULL AND c_margin_top <> 0 AND c_margin_bottom IS NOT NULL AND c_margin_bottom <> 0 AND c_margin_left IS NOT NULL AND c_margin_left <> 0 AND c_margin_right IS NOT NULL AND c_margin_right <> 0 THEN least(1::double, (c_margin_top + c_margin_bottom + c_margin_left + c_margin_right) * least(width, height) / (width * height)) END AS r FROM {visual_pairs}) WHERE r IS NOT NULL

-- w20_vlm_result
SELECT file_id, page_number, CASE WHEN boundary_score > 0.7::double THEN boundary_score END AS confidence FROM {visual}

-- w21_layout_similarity
SELECT file_id, page_number, coalesce(list_sum(s), 0) / len(s) AS similarity FROM (SELECT file_id, page_number, list_filter(list_value(CASE WHEN c_num_columns = p_num_columns THEN 1::double ELSE greatest(0::double, 1 - 0.3::double * abs(c_num_columns - p_num_columns)) END, CASE WHEN c_font_size IS NOT NULL AND c_font_size <> 0 AND p_font_size IS NOT NULL AND p_font_size <> 0 THEN greatest(0::double, 1 - abs(c_font_size - p_font_size) / 10::double) END,
  CASE WHEN c_margin_top IS NOT NULL AND c_margin_top <> 0 AND p_margin_top IS NOT NULL AND p_margin_top <> 0 AND c_margin_bottom IS NOT NULL AND c_margin_bottom <> 0 AND p_margin_bottom IS NOT NULL AND p_margin_bottom <> 0 AND c_margin_left IS NOT NULL AND c_margin_left <> 0 AND p_margin_left IS NOT NULL AND p_margin_left <> 0 AND c_margin_right IS NOT NULL AND c_margin_right <> 0 AND p_margin_right IS NOT NULL AND p_margin_right <> 0 THEN greatest(0::double, 1 - (abs(c_margin_top - p_margin_top) + abs(c_margin_bottom - p_margin_bottom) + abs(c_margin_left - p_margin_left) + abs(c_margin_right - p_margin_right)) / 4::double / 50::double) END, CASE WHEN c_orientation = p_orientation THEN 1::double ELSE 0::double END), lambda v: v IS NOT NULL) AS s FROM {visual_pairs} WHERE p_page IS NOT NULL)

-- w22_visual_continuity
SELECT file_id, page_number, CASE WHEN n = 0 THEN 0.5::double ELSE 1 - s / CASE n WHEN 1 THEN 1::double WHEN 2 THEN 1.5::double WHEN 3 THEN 1.5::double + 1 / 3::double ELSE 1.5::double + 1 / 3::double + 0.25::double END END AS break
FROM (SELECT file_id, page_number, CASE WHEN c1 IS NULL THEN 0 ELSE 1 END + CASE WHEN c2 IS NULL THEN 0 ELSE 1 END + CASE WHEN c3 IS NULL THEN 0 ELSE 1 END + CASE WHEN c4 IS NULL THEN 0 ELSE 1 END AS n, coalesce(c1 / 2::double, 0::double) + coalesce(c2 / 1::double, 0::double) + coalesce(c3 / 1::double, 0::double) + coalesce(c4 / 2::double, 0::double) AS s
  FROM (SELECT file_id, page_number, CASE WHEN n1_num_columns IS NOT NULL THEN coalesce(list_sum(a1), 0) / len(a1) END AS c1, CASE WHEN n2_num_columns IS NOT NULL THEN coalesce(list_sum(a2), 0) / len(a2) END AS c2, CASE WHEN n3_num_columns IS NOT NULL THEN coalesce(list_sum(a3), 0) / len(a3) END AS c3, CASE WHEN n4_num_columns IS NOT NULL THEN coalesce(list_sum(a4), 0) / len(a4) END AS c4
    FROM (SELECT file_id, page_number, n1_num_columns, list_filter(list_value(CASE WHEN c_num_columns = n1_num_columns THEN 1::double ELSE greatest(0::double, 1 - 0.3::double * abs(c_num_columns - n1_num_columns)) END, CASE WHEN c_font_size IS NOT NULL AND c_font_size <> 0 AND n1_font_size IS NOT NULL AND n1_font_size <> 0 THEN greatest(0::double, 1 - abs(c_font_size - n1_font_size) / 10::double) END,
  CASE WHEN c_margin_top IS NOT NULL AND c_margin_top <> 0 AND n1_margin_top IS NOT NULL AND n1_margin_top <> 0 AND c_margin_bottom IS NOT NULL AND c_margin_bottom <> 0 AND n1_margin_bottom IS NOT NULL AND n1_margin_bottom <> 0 AND c_margin_left IS NOT NULL AND c_margin_left <> 0 AND n1_margin_left IS NOT NULL AND n1_margin_left <> 0 AND c_margin_right IS NOT NULL AND c_margin_right <> 0 AND n1_margin_right IS NOT NULL AND n1_margin_right <> 0 THEN greatest(0::double, 1 - (abs(c_margin_top - n1_margin_top) + abs(c_margin_bottom - n1_margin_bottom) + abs(c_margin_left - n1_margin_left) + abs(c_margin_right - n1_margin_right)) / 4::double / 50::double) END, CASE WHEN c_orientation = n1_orientation THEN 1::double ELSE 0::double END), lambda v: v IS NOT NULL) AS a1, n2_num_columns, list_filter(list_value(CASE WHEN c_num_columns = n2_num_columns THEN 1::double ELSE greatest(0::double, 1 - 0.3::double * abs(c_num_columns - n2_num_columns)) END, CASE WHEN c_font_size IS NOT NULL AND c_font_size <> 0 AND n2_font_size IS NOT NULL AND n2_font_size <> 0 THEN greatest(0::double, 1 - abs(c_font_size - n2_font_size) / 10::double) END,
  CASE WHEN c_margin_top IS NOT NULL AND c_margin_top <> 0 AND n2_margin_top IS NOT NULL AND n2_margin_top <> 0 AND c_margin_bottom IS NOT NULL AND c_margin_bottom <> 0 AND n2_margin_bottom IS NOT NULL AND n2_margin_bottom <> 0 AND c_margin_left IS NOT NULL AND c_margin_left <> 0 AND n2_margin_left IS NOT NULL AND n2_margin_left <> 0 AND c_margin_right IS NOT NULL AND c_margin_right <> 0 AND n2_margin_right IS NOT NULL AND n2_margin_right <> 0 THEN greatest(0::double, 1 - (abs(c_margin_top - n2_margin_top) + abs(c_margin_bottom - n2_margin_bottom) + abs(c_margin_left - n2_margin_left) + abs(c_margin_right - n2_margin_right)) / 4::double / 50::double) END, CASE WHEN c_orientation = n2_orientation THEN 1::double ELSE 0::double END), lambda v: v IS NOT NULL) AS a2, n3_num_columns, list_filter(list_value(CASE WHEN c_num_columns = n3_num_columns THEN 1::double ELSE greatest(0::double, 1 - 0.3::double * abs(c_num_columns - n3_num_columns)) END, CASE WHEN c_font_size IS NOT NULL AND c_font_size <> 0 AND n3_font_size IS NOT NULL AND n3_font_size <> 0 THEN greatest(0::double, 1 - abs(c_font_size - n3_font_size) / 10::double) END,
  CASE WHEN c_margin_top IS NOT NULL AND c_margin_top <> 0 AND n3_margin_top IS NOT NULL AND n3_margin_top <> 0 AND c_margin_bottom IS NOT NULL AND c_margin_bottom <> 0 AND n3_margin_bottom IS NOT NULL AND n3_margin_bottom <> 0 AND c_margin_left IS NOT NULL AND c_margin_left <> 0 AND n3_margin_left IS NOT NULL AND n3_margin_left <> 0 AND c_margin_right IS NOT NULL AND c_margin_right <> 0 AND n3_margin_right IS NOT NULL AND n3_margin_right <> 0 THEN greatest(0::double, 1 - (abs(c_margin_top - n3_margin_top) + abs(c_margin_bottom - n3_margin_bottom) + abs(c_margin_left - n3_margin_left) + abs(c_margin_right - n3_margin_right)) / 4::double / 50::double) END, CASE WHEN c_orientation = n3_orientation THEN 1::double ELSE 0::double END), lambda v: v IS NOT NULL) AS a3, n4_num_columns, list_filter(list_value(CASE WHEN c_num_columns = n4_num_columns THEN 1::double ELSE greatest(0::double, 1 - 0.3::double * abs(c_num_columns - n4_num_columns)) END, CASE WHEN c_font_size IS NOT NULL AND c_font_size <> 0 AND n4_font_size IS NOT NULL AND n4_font_size <> 0 THEN greatest(0::double, 1 - abs(c_font_size - n4_font_size) / 10::double) END,
  CASE WHEN c_margin_top IS NOT NULL AND c_margin_top <> 0 AND n4_margin_top IS NOT NULL AND n4_margin_top <> 0 AND c_margin_bottom IS NOT NULL AND c_margin_bottom <> 0 AND n4_margin_bottom IS NOT NULL AND n4_margin_bottom <> 0 AND c_margin_left IS NOT NULL AND c_margin_left <> 0 AND n4_margin_left IS NOT NULL AND n4_margin_left <> 0 AND c_margin_right IS NOT NULL AND c_margin_right <> 0 AND n4_margin_right IS NOT NULL AND n4_margin_right <> 0 THEN greatest(0::double, 1 - (abs(c_margin_top - n4_margin_top) + abs(c_margin_bottom - n4_margin_bottom) + abs(c_margin_left - n4_margin_left) + abs(c_margin_right - n4_margin_right)) / 4::double / 50::double) END, CASE WHEN c_orientation = n4_orientation THEN 1::double ELSE 0::double END), lambda v: v IS NOT NULL) AS a4
      FROM (SELECT file_id, page_number, num_columns AS c_num_columns, lag(num_columns, 2) OVER w AS n1_num_columns, lag(num_columns, 1) OVER w AS n2_num_columns, lead(num_columns, 1) OVER w AS n3_num_columns, lead(num_columns, 2) OVER w AS n4_num_columns, font_size AS c_font_size, lag(font_size, 2) OVER w AS n1_font_size, lag(font_size, 1) OVER w AS n2_font_size, lead(font_size, 1) OVER w AS n3_font_size, lead(font_size, 2) OVER w AS n4_font_size, margin_top AS c_margin_top, lag(margin_top, 2) OVER w AS n1_margin_top, lag(margin_top, 1) OVER w AS n2_margin_top, lead(margin_top, 1) OVER w AS n3_margin_top, lead(margin_top, 2) OVER w AS n4_margin_top, margin_bottom AS c_margin_bottom, lag(margin_bottom, 2) OVER w AS n1_margin_bottom, lag(margin_bottom, 1) OVER w AS n2_margin_bottom, lead(margin_bottom, 1) OVER w AS n3_margin_bottom, lead(margin_bottom, 2) OVER w AS n4_margin_bottom, margin_left AS c_margin_left, lag(margin_left, 2) OVER w AS n1_margin_left, lag(margin_left, 1) OVER w AS n2_margin_left, lead(margin_left, 1) OVER w AS n3_margin_left, lead(margin_left, 2) OVER w AS n4_margin_left, margin_right AS c_margin_right, lag(margin_right, 2) OVER w AS n1_margin_right, lag(margin_right, 1) OVER w AS n2_margin_right, lead(margin_right, 1) OVER w AS n3_margin_right, lead(margin_right, 2) OVER w AS n4_margin_right, orientation AS c_orientation, lag(orientation, 2) OVER w AS n1_orientation, lag(orientation, 1) OVER w AS n2_orientation, lead(orientation, 1) OVER w AS n3_orientation, lead(orientation, 2) OVER w AS n4_orientation FROM {visual} WINDOW w AS (PARTITION BY file_id ORDER BY page_number)))))

-- w23_vlm_similarity
SELECT label AS file_id, vec_id AS page_number, round_even(sim, 6) AS similarity, CASE WHEN sim < 0.3::double THEN round_even(1 - sim, 6) END AS confidence
FROM (SELECT label, vec_id, 0.3::double * CASE WHEN vec_id % 3 = pv % 3 THEN 1 ELSE 0 END + 0.2::double * (CASE WHEN vec_id % 2 = pv % 2 THEN 0.5::double ELSE 0::double END + CASE WHEN vec_id % 4 < 2 THEN 0.5::double ELSE 0::double END) + 0.2::double / (1 + abs(vec_id % 3 - pv % 3)) + 0.1::double * (1 - abs(vec_id % 10 - pv % 10) / 10::double)
    + 0.2::double * CASE WHEN coalesce(list_sum(list_transform(list_zip(e, e), lambda p: p[1] * p[1])), 0) = 0 OR coalesce(list_sum(list_transform(list_zip(pe, pe), lambda p: p[1] * p[1])), 0) = 0 THEN 0::double ELSE coalesce(list_sum(list_transform(list_zip(e, pe), lambda p: p[1] * p[2])), 0) / (sqrt(coalesce(list_sum(list_transform(list_zip(e, e), lambda p: p[1] * p[1])), 0)) * sqrt(coalesce(list_sum(list_transform(list_zip(pe, pe), lambda p: p[1] * p[1])), 0))) END AS sim
  FROM (SELECT label, vec_id, e, lag(e) OVER w AS pe, lag(vec_id) OVER w AS pv FROM (SELECT label, vec_id, list_transform(embedding, lambda v: cast(v AS double)) AS e FROM {embeddings}) WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE pe IS NOT NULL)

-- w24_multimodal
SELECT file_id, page_number, CASE WHEN t < 0.4::double AND v < 0.3::double THEN 0.9::double WHEN t < 0.4::double THEN CASE WHEN v > 0.7::double THEN 0.5::double ELSE 0.7::double END WHEN v < 0.3::double THEN CASE WHEN t > 0.7::double THEN 0.4::double ELSE 0.7::double END ELSE 0::double END AS confidence
FROM (SELECT file_id, page_number, cast(doc_id * 7 % 100 AS double) / 100 AS t, boundary_score AS v FROM {visual})

-- w25_visual_summary
SELECT file_id, array_to_string(list_transform(list_sort(list_filter(list(CASE WHEN c_num_columns <> p_num_columns THEN page_number END), lambda x: x IS NOT NULL)), lambda x: cast(x AS string)), ',') AS column_changes,
  array_to_string(list_transform(list_sort(list_filter(list(CASE WHEN c_orientation <> p_orientation THEN page_number END), lambda x: x IS NOT NULL)), lambda x: cast(x AS string)), ',') AS turns,
  bool_or(c_num_tables > 0) AS has_tables, bool_or(c_has_logo) AS has_logo, bool_or(c_has_signature) AS has_signature, bool_or(c_num_columns > 1) AS multi_column FROM {visual_pairs} GROUP BY file_id

