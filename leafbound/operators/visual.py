"""Visual signals between a page and the one before, and similarities of pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.windows import beside
from leafbound.plans.ops import op, view

_FEATURES = (
    "num_columns font_size font_family alignment background ink color_images has_header has_footer header_text footer_text num_tables num_images has_logo has_signature margin_top margin_bottom margin_left margin_right orientation aspect word_count boundary_score".split()
)
view("visual_beside", "A page's features with those of the two pages before and after.", lambda visual: beside(visual.drop("text"), [*_FEATURES, "layout_types", "page_number"], back=2, ahead=2))
view("visual_pairs", "A page's features (c_) and those of the page before (p_); null on first pages.", f"SELECT file_id, page_number, doc_id, width, height, num_charts, layout_types, n_rules, {', '.join(f'{f} AS c_{f}, before1.{f} AS p_{f}' for f in _FEATURES)}, before1.page_number AS p_page, before1, after1 FROM {{visual_beside}}")
_PAIR = "FROM {visual_pairs} WHERE p_page IS NOT NULL"
_int = lambda c: f"cast(coalesce({c}, false) AS int)"
_margins = ["margin_top", "margin_bottom", "margin_left", "margin_right"]
_set = lambda *cs: " AND ".join(f"{c} IS NOT NULL AND {c} <> 0" for c in cs)
_all_margins = _set(*[f"{s}_{m}" for m in _margins for s in "cp"])

_changes = f"({_int('c_num_columns <> p_num_columns')} + {_int('c_alignment <> p_alignment')} + {_int('(c_num_tables > 0) <> (p_num_tables > 0)')})"
_edges = f"({_int('c_has_header <> p_has_header')} + {_int('c_has_footer <> p_has_footer')} + {_int('c_has_header AND p_has_header AND c_header_text <> p_header_text')} + {_int('c_has_footer AND p_has_footer AND c_footer_text <> p_footer_text')})"
_wide = f"CASE WHEN c_word_count < 50 AND {_set(*[f'c_{m}' for m in _margins])} THEN least(1D, (c_margin_top + c_margin_bottom + c_margin_left + c_margin_right) * least(width, height) / (width * height)) END"
#: Confidence of each visual signal over `visual_pairs`, null where it is silent.
SIGNALS = {
    "layout_structure": f"CASE WHEN {_changes} > 0 THEN least(0.8D, 0.3D * {_changes}) END",
    "font_style": "CASE WHEN c_font_size IS NULL OR p_font_size IS NULL THEN NULL WHEN coalesce(c_font_family <> p_font_family, false) THEN 0.7D WHEN abs(c_font_size - p_font_size) > 2 THEN 0.6D END",
    "color_scheme": f"CASE WHEN {_int('c_background <> p_background')} + {_int('c_ink <> p_ink')} + {_int('c_color_images <> p_color_images')} >= 2 THEN 0.6D END",
    "header_footer": f"CASE WHEN {_edges} > 0 THEN least(0.75D, 0.25D * {_edges}) END",
    "separator_line": "CASE WHEN n_rules > 0 THEN 0.9D END",
    "logo": "CASE WHEN c_has_logo THEN 0.85D END",
    "signature": "CASE WHEN p_has_signature THEN 0.8D END",
    "page_orientation": "CASE WHEN c_orientation <> p_orientation THEN 0.95D END",
    "column_layout": "CASE WHEN c_num_columns <> p_num_columns AND (c_num_columns = 1 OR p_num_columns = 1 OR abs(c_num_columns - p_num_columns) > 1) THEN 0.7D END",
    "whitespace_pattern": f"CASE WHEN {_wide} > 0.7D OR ({_wide} IS NOT NULL AND c_word_count < 20) THEN 0.5D + 0.3D * {_wide} END",
}
_signal = lambda t, pairs=_PAIR: f"SELECT file_id, page_number, {SIGNALS[t]} AS confidence {pairs}"
op("w9_layout_structure", "Columns, alignment or tables differ.", _signal("layout_structure"))
op("w10_font_change", "Another font, or another size by more than two points.", _signal("font_style"))
op("w11_color_change", "Two of background, ink and colour images differ.", _signal("color_scheme"))
op("w12_margin_change", "Two margins differ by more than twenty; zero counts as not measured.", f"SELECT file_id, page_number, CASE WHEN {_all_margins} AND {' + '.join(_int(f'abs(c_{m} - p_{m}) > 20') for m in _margins)} >= 2 THEN 0.65D END AS confidence {_PAIR}")
op("w13_header_footer_change", "Headers and footers come, go or read differently.", _signal("header_footer"))
op("w14_visual_separator", "Rules across the page: wide flat boxes, or lines of dashes.", """
SELECT file_id, page_number, cast(sum(CASE WHEN w / greatest(h, 1D) > 50 AND h < 5 OR block_text IN ('---', '___', '***', '• • •', '···') THEN 1 ELSE 0 END) AS bigint) AS n,
  CASE WHEN sum(CASE WHEN w / greatest(h, 1D) > 50 AND h < 5 OR block_text IN ('---', '___', '***', '• • •', '···') THEN 1 ELSE 0 END) > 0 THEN 0.9D END AS confidence FROM {blocks} GROUP BY file_id, page_number""")
op("w15_logo", "A logo opens a document.", _signal("logo", "FROM {visual_pairs}"))
op("w16_signature", "A signature closes one; the signal stands on the page that has it.", f"SELECT file_id, p_page AS signal_page, page_number, {SIGNALS['signature']} AS confidence {_PAIR}")
op("w17_orientation", "The page is turned.", _signal("page_orientation"))
op("w18_column_change", "From or to one column, or by more than one.", _signal("column_layout"))
op("w19_whitespace_pattern", "Few words between wide margins.", f"SELECT file_id, page_number, {SIGNALS['whitespace_pattern']} AS confidence FROM {{visual_pairs}} WHERE {_wide} IS NOT NULL")
op("w20_vlm_result", "A vision model's own boundary score.", "SELECT file_id, page_number, CASE WHEN boundary_score > 0.7D THEN boundary_score END AS confidence FROM {visual}", per_page=True)
_SIM = f"""array(CASE WHEN c_num_columns = p_num_columns THEN 1D ELSE greatest(0D, 1 - 0.3D * abs(c_num_columns - p_num_columns)) END, CASE WHEN {_set("c_font_size", "p_font_size")} THEN greatest(0D, 1 - abs(c_font_size - p_font_size) / 10D) END,
  CASE WHEN {_all_margins} THEN greatest(0D, 1 - ({" + ".join(f"abs(c_{m} - p_{m})" for m in _margins)}) / 4D / 50D) END, CASE WHEN c_orientation = p_orientation THEN 1D ELSE 0D END)"""
op("w21_layout_similarity", "Mean likeness of columns, fonts, margins and orientation, of those known on both pages.", f"SELECT file_id, page_number, aggregate(s, 0D, (a, v) -> a + v) / size(s) AS similarity FROM (SELECT file_id, page_number, filter({_SIM}, v -> v IS NOT NULL) AS s {_PAIR})")
op("w22_visual_continuity", "How a page breaks with its surroundings within two pages, nearer ones weighing more.", f"""
SELECT file_id, page_number, CASE WHEN n = 0 THEN 0.5D ELSE 1 - s / CASE n WHEN 1 THEN 1D WHEN 2 THEN 1.5D WHEN 3 THEN 1.5D + 1 / 3D ELSE 1.5D + 1 / 3D + 0.25D END END AS break
FROM (SELECT file_id, page_number, {" + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ("c1", "c2", "c3", "c4"))} AS n, {" + ".join(f"coalesce({c} / {d}D, 0D)" for c, d in (("c1", 2), ("c2", 1), ("c3", 1), ("c4", 2)))} AS s
  FROM (SELECT file_id, page_number, {", ".join(f"CASE WHEN n{i}_num_columns IS NOT NULL THEN aggregate(a{i}, 0D, (a, v) -> a + v) / size(a{i}) END AS c{i}" for i in range(1, 5))}
    FROM (SELECT file_id, page_number, {", ".join(f"n{i}_num_columns, filter({_SIM.replace('p_', f'n{i}_')}, v -> v IS NOT NULL) AS a{i}" for i in range(1, 5))}
      FROM (SELECT file_id, page_number, {", ".join(f"{x} AS c_{x}, " + ", ".join(f"{side}.{x} AS n{i}_{x}" for i, side in enumerate(("before2", "before1", "after1", "after2"), 1)) for x in ("num_columns", "font_size", *_margins, "orientation"))} FROM {{visual_beside}}))))
""")


def cosine(a: str, b: str) -> str:
    """SQL for the cosine of two arrays; zero if either is all zeros."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (a, b) -> a * b), 0D, (a, v) -> a + v)"
    return f"CASE WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN 0D ELSE {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END"


_LIKE = f"""0.3D * CASE WHEN layout = before1.layout THEN 1 ELSE 0 END + 0.2D * (CASE WHEN header = before1.header THEN 0.5D ELSE 0D END + CASE WHEN same_footer THEN 0.5D ELSE 0D END) + 0.2D / (1 + abs(columns - before1.columns))
    + 0.1D * (1 - abs(whitespace - before1.whitespace)) + 0.2D * {cosine("signature", "before1.signature")}"""


def vlm_similarity(vlm_pages: DataFrame) -> DataFrame:
    """What a vision model says of pages (layout, header, same_footer, columns, whitespace, signature vector), compared with the page before."""
    pairs = beside(vlm_pages, ["layout", "header", "columns", "whitespace", "signature"]).where("before1 IS NOT NULL").withColumn("sim", F.expr(_LIKE))
    return pairs.selectExpr("file_id", "page_number", "bround(sim, 6) AS similarity", "CASE WHEN sim < 0.3D THEN bround(1 - sim, 6) END AS confidence")


op("w23_vlm_similarity", "Likeness of neighbouring pages: layout, header and footer, columns, white space, signature vectors.", vlm_similarity)
op("w24_multimodal", "Text and vision together: agreement is strong, each alone is checked by the other.", """
SELECT file_id, page_number, CASE WHEN text_likeness < 0.4D AND visual_likeness < 0.3D THEN 0.9D WHEN text_likeness < 0.4D THEN CASE WHEN visual_likeness > 0.7D THEN 0.5D ELSE 0.7D END
  WHEN visual_likeness < 0.3D THEN CASE WHEN text_likeness > 0.7D THEN 0.4D ELSE 0.7D END ELSE 0D END AS confidence FROM {likeness}""", per_page=True)
op("w25_visual_summary", "Where columns or orientation change, and what a file has at all.", f"""
SELECT file_id, array_join(transform(array_sort(filter(collect_list(CASE WHEN c_num_columns <> p_num_columns THEN page_number END), x -> x IS NOT NULL)), x -> cast(x AS string)), ',') AS column_changes,
  array_join(transform(array_sort(filter(collect_list(CASE WHEN c_orientation <> p_orientation THEN page_number END), x -> x IS NOT NULL)), x -> cast(x AS string)), ',') AS turns,
  bool_or(c_num_tables > 0) AS has_tables, bool_or(c_has_logo) AS has_logo, bool_or(c_has_signature) AS has_signature, bool_or(c_num_columns > 1) AS multi_column FROM {{visual_pairs}} GROUP BY file_id""")
