"""Plugins, visual and model detectors fused into page ranges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.intervals import cover
from leafbound.functions.windows import running
from leafbound.operators import detectors
from leafbound.operators.pairs import VISUAL_CHANGE
from leafbound.operators.segments import COLS, WEIGHTS, closed
from leafbound.operators.text import CONSTRUCTION
from leafbound.operators.visual import SIGNALS
from leafbound.plans.ops import op, view

# Weights of signal types among plugins, and of visual signals.
PLUGIN = {"document_header": "0.85", "email_header": "0.9", "page_number_reset": "0.7", "layout_change": "0.6", "white_space": "0.5", "document_type_change": "0.8", "llm_semantic": "0.8", "vlm_visual": "0.7", "construction_specific": "1.2"}
VISUAL = {"layout_structure": "0.8", "font_style": "0.7", "color_scheme": "0.6", "separator_line": "0.9", "header_footer": "0.75", "logo": "0.85", "signature": "0.8", "page_orientation": "0.95", "column_layout": "0.7", "whitespace_pattern": "0.5"}
# Visual signals in the rule detector's terms.
STANDARD = {"layout_structure": "layout_change", "column_layout": "layout_change", "page_orientation": "layout_change", "font_style": "layout_change", "color_scheme": "layout_change", "header_footer": "layout_change", "separator_line": "visual_separator", "whitespace_pattern": "visual_separator", "logo": "document_header", "signature": "document_header"}
def _case(col: str, weights: dict[str, str], default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in weights.items()) + f" ELSE {default} END"


_family = " ".join(f"WHEN '{t}' THEN {c}D" for t, c, _ in CONSTRUCTION)
_found = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN named_struct('plugin', '{p}', 'signal', '{t}', 'confidence', {c}) END" for p, t, c in [*(("rule", t, c) for t, c in COLS.items()), ("construction", "construction_specific", "c7"), ("vlm", "vlm_visual", "c8")])
view("built_in_signals", "Every page with the signals of the built-in detectors in a list: rules, construction patterns, a vision model's.", f"""
SELECT file_id, page_number, kind, is_last, rule_confidence, n_rules, c7, filter(array({_found}), x -> x IS NOT NULL) AS found FROM (
SELECT r.*, r.confidence AS rule_confidence, r.n_signals AS n_rules, CASE family_begins {_family} END AS c7, CASE WHEN v.score > 0.6D THEN v.score END AS c8 FROM {{rule_pages}} r
LEFT JOIN (SELECT file_id, page_number, {VISUAL_CHANGE.replace("p.", "before1.")} AS score FROM {{visual_beside}} WHERE before1.word_count IS NOT NULL) v ON r.file_id IS NOT DISTINCT FROM v.file_id AND r.page_number = v.page_number)""")


def with_registered(built_in_signals: DataFrame, pages_seeded: DataFrame) -> DataFrame:
    """The same with the signals of registered detectors."""
    extra = detectors.signals(pages_seeded)
    if extra is None:
        return built_in_signals
    listed = extra.groupBy(F.col("file_id").alias("_file"), F.col("page_number").alias("_page")).agg(F.collect_list(F.struct("plugin", "signal", "confidence")).alias("extra"))
    both = built_in_signals.join(listed, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("page_number") == F.col("_page")), "left")
    return both.withColumn("found", F.when(F.col("extra").isNull(), F.col("found")).otherwise(F.concat("found", "extra"))).drop("_file", "_page", "extra")


def weighed(plugin_pages: DataFrame) -> DataFrame:
    """Means by signal type, weighed by type, raised where two or three types agree; null where there are no signals."""
    weights = {**{k: float(v) for k, v in PLUGIN.items()}, **detectors.weights()}
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    types = F.array_distinct(F.transform("found", lambda x: x["signal"]))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def mean(t):
        own = F.filter("found", lambda x: x["signal"] == t)
        return total(F.transform(own, lambda x: x["confidence"])) / F.size(own)

    w = lambda t: F.coalesce(F.try_element_at(weight, t), F.lit(0.5))
    v = total(F.transform(types, lambda t: mean(t) * w(t))) / total(F.transform(types, w))
    raised = F.when(F.size(types) >= 3, 1.2).when(F.size(types) == 2, 1.1).otherwise(1.0)
    return plugin_pages.withColumns({"n_signals": F.size("found").cast("bigint"), "n_types": F.size(types).cast("bigint"), "confidence": F.when(F.size("found") > 0, F.bround(F.least(F.lit(1.0), v * raised), 9))})


# Page 1 has its own type's vote, with a confidence that no other reaches; else the rules' type and a report, which construction patterns stand for, vote by their confidence.
_VOTE = """CASE WHEN page_number = 1 THEN coalesce(kind, 'other') WHEN n_rules > 0 AND kind IS NOT NULL AND (c7 IS NULL OR kind = 'report' OR rule_confidence >= c7) THEN kind WHEN c7 IS NOT NULL THEN 'report' END"""
view("plugin_pages", "Every page with the signals of all detectors.", with_registered)
view("plugin_votes", "Every page with its fused confidence.", weighed)
op("b6_plugin_group", "Candidates of all plugins by page: rules, construction patterns, a vision model's, registered detectors'.", "SELECT file_id, page_number, plugin, signal, confidence FROM (SELECT file_id, page_number, inline(found) FROM {plugin_pages})")
op("b7_plugin_confidence", "Means by signal type, weighed by type, raised where two or three types agree.", "SELECT file_id, page_number, n_signals, n_types, confidence FROM {plugin_votes} WHERE n_signals > 0")
op("b8_type_vote", "The type with most confidence behind it; page 1 also has its own type's vote.", f"SELECT file_id, page_number, document_type FROM (SELECT file_id, page_number, {_VOTE} AS document_type FROM {{built_in_signals}}) WHERE document_type IS NOT NULL")


def plugin_segment(plugin_votes: DataFrame) -> DataFrame:
    first = F.col("page_number") == 1
    voted = plugin_votes.withColumns({"starts": first | F.coalesce(F.col("confidence") >= 0.6, F.lit(False)), "kind": F.when(first, F.col("kind")).otherwise(F.expr(_VOTE)), "confidence": F.when(first, F.lit(1.0)).otherwise(F.col("confidence"))})
    return closed(voted)


op("b9_plugin_segment", "Page ranges of the plugins together.", plugin_segment)
_seen = ", ".join(f"named_struct('signal', '{t}', 'confidence', {c}, 'weight', {VISUAL[t]}D)" for t, c in SIGNALS.items())
view("visual_pages", "Every page with its visual signals in a list (none on page 1), and what its type goes by.", f"""
SELECT file_id, page_number, c_num_tables AS num_tables, c_has_signature AS has_signature, num_charts, c_num_images AS num_images, c_num_columns AS num_columns, c_has_header AS has_header, c_has_footer AS has_footer, c_has_logo AS has_logo,
  CASE WHEN page_number > 1 THEN filter(array({_seen}), x -> x.confidence IS NOT NULL) ELSE filter(array({_seen}), x -> false) END AS found FROM {{visual_pairs}}""")
view("visual_votes", "Every page with its visual confidence: the weighted mean, raised if two signals are strong; null without signals.", """
SELECT *, size(found) AS n_signals, CASE WHEN size(found) > 0 THEN bround(CASE WHEN size(filter(found, x -> x.confidence >= 0.7D)) >= 2 THEN least(1D, v * 1.15D) ELSE v END, 9) END AS confidence
FROM (SELECT *, aggregate(found, 0D, (a, x) -> a + x.confidence * x.weight) / aggregate(found, 0D, (a, x) -> a + x.weight) AS v FROM {visual_pages})""".replace("/ aggregate(found, 0D, (a, x) -> a + x.weight)", "/ nullif(aggregate(found, 0D, (a, x) -> a + x.weight), 0D)"))
view("visual_signals", "One row for each visual signal from page 2 on.", "SELECT file_id, page_number, signal, confidence FROM (SELECT file_id, page_number, inline(found) FROM {visual_pages})")
op("b10_visual_confidence", "Weighted mean of the visual signals, raised if two are strong.", "SELECT file_id, page_number, cast(n_signals AS bigint) AS n_signals, confidence FROM {visual_votes} WHERE n_signals > 0")
_LOOKS = """CASE WHEN num_tables > 2 OR has_signature AND num_tables > 0 THEN 'form' WHEN num_charts > 0 AND num_images > 2 THEN 'presentation' WHEN num_tables > 3 AND num_images = 0 THEN 'spreadsheet'
  WHEN has_signature AND num_columns = 1 THEN 'letter' WHEN num_columns > 1 OR has_header AND has_footer THEN 'report' ELSE 'other' END"""
op("b12_page_type", "What a page looks like.", f"SELECT file_id, page_number, {_LOOKS} AS document_type FROM {{visual}}", per_page=True)
view("fused_pages", "Every page with its text and visual candidates, one side or both.", f"""
SELECT *, CASE WHEN NOT t THEN CASE WHEN look > 0.7D THEN look * 0.8D END WHEN NOT v THEN say ELSE least(1D, (0.6D * say + 0.4D * look) * 1.1D) END AS confidence, CASE WHEN NOT t THEN 'visual' WHEN NOT v THEN 'text' ELSE 'both' END AS method
FROM (SELECT r.file_id, r.page_number, r.is_last, r.kind, r.starts AS t, CASE WHEN r.page_number = 1 THEN 1D ELSE r.confidence END AS say, coalesce(v.confidence >= 0.5D AND v.n_signals >= 1, false) AS v, v.confidence AS look, v.document_type AS looks
  FROM {{rule_pages}} r LEFT JOIN (SELECT file_id, page_number, confidence, n_signals, {_LOOKS} AS document_type FROM {{visual_votes}}) v ON r.file_id IS NOT DISTINCT FROM v.file_id AND r.page_number = v.page_number)""")
view("fused", "Text and visual candidates by page.", "SELECT file_id, page_number, method, confidence, CASE WHEN t THEN kind END AS kind FROM {fused_pages} WHERE t OR v")
op("b11_hybrid_fuse", "Page ranges of text and vision together.", lambda fused_pages: closed(fused_pages.withColumns({"starts": F.expr("(t OR v) AND coalesce(confidence >= 0.6D, false)"), "kind": F.expr("CASE WHEN t THEN kind ELSE looks END")})))


def range_types(b11_hybrid_fuse: DataFrame, visual: DataFrame) -> DataFrame:
    """What a range of pages looks like, by the pages in it."""
    pages = cover(visual.select("file_id", "page_number", "has_logo", "has_signature", "num_tables", "num_columns"), b11_hybrid_fuse.select("file_id", "start_page", "end_page"))
    kind = F.expr("""CASE WHEN bool_or(has_logo) AND avg(num_tables) > 0.5D THEN 'invoice' WHEN bool_or(has_signature) AND count(*) <= 3 THEN 'letter' WHEN avg(num_tables) > 1 THEN 'report'
        WHEN bool_or(num_columns > 1) AND count(*) > 5 THEN 'report' WHEN bool_or(has_logo) AND count(*) = 1 THEN 'form' ELSE 'other' END""")
    return pages.groupBy("file_id", "start_page").agg(kind.alias("document_type"))


op("b13_range_type", "What a range of pages looks like.", range_types)
op("b14_visual_to_standard", "Visual signals in the rule detector's terms.", f"SELECT file_id, page_number, CASE signal {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STANDARD.items())} END AS signal, concat('[Visual] ', signal) AS description, confidence FROM {{visual_signals}}")
_others = [c for t, c in COLS.items() if t != "white_space"]
_n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in _others)
_num, _den = " + ".join(f"coalesce({COLS[t]} * {w}D, 0D)" for t, w in WEIGHTS.items() if t != "white_space"), " + ".join(f"CASE WHEN {COLS[t]} IS NULL THEN 0D ELSE {w}D END" for t, w in WEIGHTS.items() if t != "white_space")
_sure = "(CASE WHEN n > 0 THEN above / below END)"
op("b15_ambiguous_cases", "Pages the rules can't settle: middling confidence, or one weak signal.", f"""
SELECT file_id, page_number, sure AS confidence FROM (SELECT file_id, page_number, starts, confidence, n, {_sure} AS sure FROM (SELECT *, {_n} AS n, {_num} AS above, {_den} AS below FROM {{rule_pages}}))
WHERE n > 0 AND (sure BETWEEN 0.4D AND 0.75D OR n = 1 AND sure < 0.6D) AND NOT (starts AND confidence >= 0.75D)""")


def merge_verdicts(rule_pages: DataFrame, llm_verdicts: DataFrame) -> DataFrame:
    """Ranges by the rules and a model's verdicts (file_id, page_number, yes, confidence, document_type): raised, added or dropped."""
    said = llm_verdicts.select(F.col("file_id").alias("_file"), F.col("page_number").alias("_page"), "yes", F.col("confidence").alias("sure"), F.col("document_type").alias("said"))
    both = rule_pages.withColumn("confidence", F.when(F.col("page_number") == 1, F.lit(1.0)).otherwise(F.col("confidence")))
    both = both.join(said, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("page_number") == F.col("_page")), "left")
    agreed = F.coalesce(F.col("yes") & (F.col("sure") >= 0.6), F.lit(False))
    refused = F.coalesce(~F.col("yes") & (F.col("confidence") < 0.7), F.lit(False))
    own = F.when(F.col("starts"), F.col("confidence"))
    return closed(both.withColumns({
        "confidence": F.when(agreed, F.greatest(F.coalesce(own, F.lit(0.0)), F.col("sure"))).otherwise(own), "kind": F.when(agreed, F.col("said")).when(F.col("starts"), F.col("kind")),
        "starts": (F.col("starts") & ~refused) | agreed,
    }))


op("b16_llm_merge", "Rule boundaries with the model's verdicts: raised, added or dropped.", merge_verdicts)
op("b17_method_merge", "Two methods' ranges by start page; the model's win.", """
SELECT coalesce(l.file_id, r.file_id) AS file_id, coalesce(l.start_page, r.start_page) AS start_page, CASE WHEN l.start_page IS NOT NULL THEN l.end_page ELSE r.end_page END AS end_page, CASE WHEN l.start_page IS NOT NULL THEN l.confidence ELSE r.confidence END AS confidence, CASE WHEN l.start_page IS NOT NULL THEN 'llm' ELSE 'rule' END AS method
FROM {b16_llm_merge} l FULL OUTER JOIN {b9_plugin_segment} r ON l.file_id IS NOT DISTINCT FROM r.file_id AND l.start_page = r.start_page""")


def merge_close(found: DataFrame, gap: int = 2, where: str | None = None) -> DataFrame:
    """Ranges that start within `gap` pages of the end of those before become one; with `where` (a boolean column), only where it holds."""
    merges = F.coalesce(F.col(where), F.lit(False)) if where else F.lit(True)
    rows = running(found, "_before", F.col("end_page"), "max", own=False, order="start_page")
    rows = rows.withColumn("_starts", F.when(merges & F.coalesce(F.col("start_page") - F.col("_before") <= gap, F.lit(False)), 0).otherwise(1))
    rows = running(rows, "_island", F.col("_starts"), order="start_page")
    return rows.groupBy("file_id", "_island").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.max("confidence").alias("confidence"), F.count("*").alias("n_merged")).drop("_island")


def merge_in_construction(found: DataFrame, hints: DataFrame) -> DataFrame:
    """Close ranges become one in files that hold construction papers. hints: (file_id, construction)."""
    hint = hints.select(F.col("file_id").alias("_file"), "construction")
    return merge_close(found.join(hint, F.col("file_id").eqNullSafe(F.col("_file"))).drop("_file"), where="construction")


def post_process(found: DataFrame, *steps) -> DataFrame:
    """Ranges through steps in order; a step is a function of ranges, or such a function with its further arguments: (step, argument, ...)."""
    for step in steps:
        f, *args = step if isinstance(step, tuple) else (step,)
        found = found.transform(f, *args)
        lacking = {"file_id", "start_page", "end_page", "confidence"} - set(found.columns)
        if lacking:
            raise TypeError(f"{getattr(f, '__name__', f)} gives ranges without {', '.join(sorted(lacking))}")
    return found


op("b18_merge_close", "Ranges that start within two pages of the last one's end become one.", lambda b4_segment_pages: post_process(b4_segment_pages, merge_close).select("file_id", "start_page", "end_page", "confidence", "n_merged"))
op("b19_enhanced_post", "Close ranges merged where the file holds construction papers, else left.", lambda b4_segment_pages, t10_type_hints: post_process(b4_segment_pages, (merge_in_construction, t10_type_hints)).select("file_id", "start_page", "end_page", "confidence"))


def named_parts(found: DataFrame) -> DataFrame:
    rows = running(found, "_n", F.lit(1), order="start_page")
    span = F.when(F.col("start_page") == F.col("end_page"), F.col("start_page").cast("string")).otherwise(F.concat(F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string")))
    return rows.select("file_id", "start_page", F.format_string("%s_part_%03d", "file_id", F.col("_n").cast("int")).alias("name"), (F.col("end_page") - F.col("start_page") + 1).alias("page_count"), span.alias("page_range"))


op("b20_split_naming", "Names and page counts of the parts a file is split into.", lambda b4_segment_pages: named_parts(b4_segment_pages))
op("b21_validate_update", "Ranges given by hand, with what is wrong with them.", """
SELECT u.file_id, u.start_page, u.end_page, CASE WHEN u.start_page < 1 THEN 'start below 1' WHEN u.end_page < u.start_page THEN 'end before start' WHEN u.end_page > l.last_page THEN 'end beyond file' ELSE 'ok' END AS verdict
FROM (SELECT file_id, start_page - 1 + start_page % 2 AS start_page, end_page + CASE WHEN start_page % 5 = 0 THEN 9 ELSE 0 END AS end_page FROM {truth}) u JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_doc} GROUP BY file_id) l ON u.file_id IS NOT DISTINCT FROM l.file_id""")
op("b22_early_optimize", "Whether a file's first third settles enough to process the rest fast.", """
SELECT file_id, avg_confidence, n_found, (avg_confidence >= 0.75D AND expected BETWEEN 2 AND 20) AS downgrade FROM (SELECT b.file_id, bround(avg(b.confidence), 9) AS avg_confidence, count(*) AS n_found, count(*) * 10 / 3D AS expected
FROM {b4_segment_pages} b JOIN (SELECT file_id, max(page_number) AS last_page FROM {pages_doc} GROUP BY file_id) l ON b.file_id IS NOT DISTINCT FROM l.file_id AND b.start_page <= 0.3D * l.last_page GROUP BY b.file_id)""")
op("b23_low_confidence", "Boundaries a model should look at again.", "SELECT file_id, start_page, confidence FROM {b4_segment_pages} WHERE confidence < 0.7D")
