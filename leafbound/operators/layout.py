"""Geometry of a page's blocks."""

from leafbound.functions.windows import beside
from leafbound.operators.visual import cosine
from leafbound.plans.ops import op, view

view("clustered", "Text blocks with the number of the cluster their left edge falls in: a gap over 50 starts one.", """
SELECT file_id, page_number, b, x, sum(starts) OVER (PARTITION BY file_id, page_number ORDER BY x, b ROWS UNBOUNDED PRECEDING) AS cluster
FROM (SELECT file_id, page_number, b, x, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY file_id, page_number ORDER BY x, b) > 50, true) THEN 1 ELSE 0 END AS starts FROM {blocks} WHERE kind = 'text')""")
op("g1_cluster_positions", "Clusters of left edges by single linkage.", "SELECT file_id, page_number, cast(cluster AS bigint) AS cluster, count(*) AS n, min(x) AS from_x, max(x) AS to_x FROM {clustered} GROUP BY file_id, page_number, cluster")
op("g2_num_columns", "Columns of text; one where there is no text.", "SELECT p.file_id, p.page_number, cast(coalesce(max(c.cluster), 1) AS bigint) AS num_columns FROM {pages_doc} p LEFT JOIN {clustered} c ON p.file_id IS NOT DISTINCT FROM c.file_id AND p.page_number = c.page_number GROUP BY p.file_id, p.page_number")
op("g3_layout_type", "Empty, single, two or multi column.", """
SELECT p.file_id, p.page_number, CASE WHEN max(c.cluster) IS NULL THEN 'empty' WHEN max(c.cluster) = 1 THEN 'single_column' WHEN max(c.cluster) = 2 THEN 'two_column' ELSE 'multi_column' END AS layout_type
FROM {pages_doc} p LEFT JOIN {clustered} c ON p.file_id IS NOT DISTINCT FROM c.file_id AND p.page_number = c.page_number GROUP BY p.file_id, p.page_number""")
op("g4_header_footer", "Text in the top and bottom tenth of the page.", """
SELECT file_id, page_number, bool_or(y < 79.2D) AS has_header, bool_or(y + h > 712.8D) AS has_footer, array_join(array_sort(filter(collect_list(CASE WHEN y < 79.2D THEN block_text END), s -> s IS NOT NULL)), ' ') AS header_text,
  array_join(array_sort(filter(collect_list(CASE WHEN y + h > 712.8D THEN block_text END), s -> s IS NOT NULL)), ' ') AS footer_text FROM {blocks} GROUP BY file_id, page_number""")
op("g5_whitespace_ratio", "The share of the page no block covers.", "SELECT file_id, page_number, bround(1 - sum(w * h) / (612D * 792D), 6) AS ratio FROM {blocks} GROUP BY file_id, page_number")
op("g6_visual_signature", "Nine numbers that stand for a page's layout.", """
SELECT file_id, page_number, count_if(kind = 'text') / 100D AS texts, count_if(kind IN ('picture', 'figure')) / 10D AS images, count_if(kind = 'table') / 5D AS tables, bround(avg(x / 612), 6) AS mean_x, bround(avg(y / 792), 6) AS mean_y,
  bround(stddev_pop(x / 612), 6) AS std_x, bround(stddev_pop(y / 792), 6) AS std_y, bround(avg(w / 612), 6) AS mean_w, bround(avg(h / 792), 6) AS mean_h FROM {blocks} GROUP BY file_id, page_number""")
op("g7_cosine", "Cosine of each vector with the one before; zero if either is null.", lambda vlm_pages: beside(vlm_pages, ["signature"]).where("before1 IS NOT NULL").selectExpr("page_number AS vec_id", f"bround({cosine('signature', 'before1.signature')}, 6) AS cosine"))
op("g8_classify_blocks", "Blocks by what their kind's name holds.", "SELECT file_id, page_number, b, CASE WHEN contains(kind, 'text') OR contains(kind, 'paragraph') THEN 'text' WHEN contains(kind, 'image') OR contains(kind, 'figure') OR contains(kind, 'picture') THEN 'image' WHEN contains(kind, 'table') THEN 'table' END AS class FROM {blocks} WHERE w > 0 AND h > 0")
op("g9_primary_font", "The commonest size and family; of equals the least.", """
SELECT s.file_id, s.page_number, s.font_size, f.font_family FROM (SELECT file_id, page_number, font_size, row_number() OVER (PARTITION BY file_id, page_number ORDER BY count(*) DESC, font_size) AS r FROM {blocks} GROUP BY file_id, page_number, font_size) s
JOIN (SELECT file_id, page_number, font_family, row_number() OVER (PARTITION BY file_id, page_number ORDER BY count(*) DESC, font_family) AS r FROM {blocks} GROUP BY file_id, page_number, font_family) f ON s.file_id IS NOT DISTINCT FROM f.file_id AND s.page_number = f.page_number AND s.r = 1 AND f.r = 1""")
op("g10_count_elements", "Pictures, charts and tables of a page.", "SELECT file_id, page_number, count_if(kind IN ('picture', 'image', 'figure')) AS images, count_if(contains(kind, 'chart')) AS charts, count_if(kind = 'table') AS tables FROM {blocks} GROUP BY file_id, page_number")
op("g12_orientation", "Landscape from an aspect of 1.2.", "SELECT file_id, page_number, CASE WHEN aspect > 1.2D THEN 'landscape' ELSE 'portrait' END AS orientation FROM {visual}", per_page=True)
op("g13_constants", "What the engine doesn't measure: alignment, picture classes, a vision model's analysis.", "SELECT file_id, page_number, 'left' AS alignment, cast(NULL AS string) AS picture_classes, cast(NULL AS string) AS vlm_analysis FROM {pages_doc}", per_page=True)
