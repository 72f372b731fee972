"""Per-page text detectors and text shaping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.windows import beside
from leafbound.plans.ops import op, view
from leafbound.sources.samples import TEMPLATES

#: Header fields of an e-mail, each at the start of a line.
EMAIL = ["From", "To", "Subject", "Date", "Sent"]
_SFX = r"\s*(?:#|no\.?|number)?\s*:?\s*(\d+)"
#: Document headings, the first that fits counts.
HEADINGS = [
    ("invoice", r"(?:invoice|inv)" + _SFX), ("purchase_order", r"(?:purchase\s*order|p\.?o\.?)" + _SFX), ("quote", r"(?:quote|quotation)" + _SFX), ("contract", r"(?:contract)" + _SFX),
    ("submittal", r"(?:submittal)" + _SFX), ("rfi", r"(?:rfi|request\s*for\s*information)" + _SFX), ("proposal", r"(?:proposal|cost\s*proposal)" + _SFX),
    ("application", r"(?:application\s*for\s*payment)"), ("schedule", r"(?:schedule\s*of\s*values)"),
]
#: First-page marks on a line.
RESETS = [r"(?i)^\s*(?:page\s*)?1\s*(?:of\s*\d+)?\s*$", r"^\s*-?\s*1\s*-?\s*$", r"(?i)(?:page|p\.?)\s*1\b"]
#: Families of construction papers: type, confidence, patterns of which two must occur.
CONSTRUCTION = [
    ("rfi", "0.9", [r"RFI\s*#?\s*\d+", r"REQUEST\s+FOR\s+INFORMATION", r"RFI\s+LOG\s+NO", r"RESPONSE\s+REQUIRED\s+BY"]),
    ("submittal", "0.85", [r"SUBMITTAL\s*#?\s*\d+", r"SUBMITTAL\s+TRANSMITTAL", r"SHOP\s+DRAWING", r"PRODUCT\s+DATA", r"MATERIAL\s+SAMPLE"]),
    ("change_order", "0.9", [r"CHANGE\s+ORDER\s*#?\s*\d+", r"CONTRACT\s+MODIFICATION", r"COST\s+IMPACT", r"SCHEDULE\s+IMPACT", r"PCO\s*#?\s*\d+"]),
    ("daily_report", "0.8", [r"DAILY\s+(?:CONSTRUCTION\s+)?REPORT", r"WEATHER\s+CONDITIONS", r"MANPOWER\s+ON\s+SITE", r"WORK\s+PERFORMED\s+TODAY", r"EQUIPMENT\s+ON\s+SITE"]),
    ("safety_document", "0.85", [r"SAFETY\s+(?:MEETING|REPORT|INSPECTION)", r"JOB\s+HAZARD\s+ANALYSIS", r"INCIDENT\s+REPORT", r"NEAR\s+MISS", r"TOOLBOX\s+TALK"]),
    ("meeting_minutes", "0.8", [r"MEETING\s+MINUTES", r"ATTENDEES\s*:", r"ACTION\s+ITEMS", r"NEXT\s+MEETING", r"OAC\s+MEETING"]),
]
#: Words that hint at a first page, for the OCR plan and for the LLM plan.
POTENTIAL = ["from:", "to:", "subject:", "date:", "invoice", "purchase order", "contract", "page 1", "1 of", "dear", "sincerely", "regards", "application", "form", "questionnaire"]
INDICATORS = ["from:", "to:", "subject:", "invoice", "bill", "statement", "page 1", "page 1 of", "dear", "sincerely", "contract", "agreement"]
#: Names in a model's replies, and the types they mean.
LLM_TYPES = {
    "email": "email", "email chain": "email", "invoice": "invoice", "purchase order": "invoice", "purchase_order": "invoice", "contract": "contract", "report": "report", "rfi": "report", "submittal": "report",
    "letter": "letter", "form": "form", "presentation": "presentation", "spreadsheet": "spreadsheet", "proposal": "report",
}


def hits(col: str, patterns: list[str], flags: str = "(?im)") -> str:
    """How many of the patterns occur."""
    return "(" + " + ".join(f"cast(regexp_like({col}, r'{flags}{p}') AS int)" for p in patterns) + ")"


def any_of(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


EMAIL_HITS = hits("h{n}", [rf"^{f}:\s*(.+)$" for f in EMAIL])
HEADING = "CASE " + " ".join(f"WHEN regexp_like(l500, r'(?i){p}') THEN '{n}'" for n, p in HEADINGS) + " END"
_T1000 = "l1000"
TYPE = f"""CASE WHEN text = '' THEN NULL WHEN {EMAIL_HITS.replace("{n}", "500")} >= 2 THEN 'email' WHEN {any_of(_T1000, ["invoice", "bill to", "ship to", "total amount"])} THEN 'invoice'
  WHEN {any_of(_T1000, ["purchase order", "p.o.", "po number"])} THEN 'invoice' WHEN {any_of(_T1000, ["quotation", "quote", "estimate"])} THEN 'other'
  WHEN contains({_T1000}, 'contract') AND contains({_T1000}, 'agreement') THEN 'contract'
  WHEN {any_of(_T1000, ["request for information", "rfi", "submittal", "proposal", "cost proposal", "schedule of values"])} THEN 'report' WHEN contains({_T1000}, 'application for payment') THEN 'form'
  WHEN {any_of(_T1000, ["executive summary", "table of contents", "introduction", "conclusion"])} THEN 'report' WHEN {any_of(_T1000, ["dear", "sincerely", "regards", "yours truly"])} THEN 'letter' ELSE 'other' END"""
FAMILY = "CASE " + " ".join(f"WHEN {hits('h1000', ps)} >= 2 THEN '{t}'" for t, _, ps in CONSTRUCTION) + " END"
FAMILY_CONFIDENCE = "CASE family " + " ".join(f"WHEN '{t}' THEN {c}D" for t, c, _ in CONSTRUCTION) + " END"

op("t1_email_header", "E-mail header lines: two of five make a signal.", f"SELECT file_id, page_number, m AS n_fields, CASE WHEN m >= 2 THEN least(0.9D, 0.3D * m) END AS confidence FROM (SELECT file_id, page_number, {EMAIL_HITS.replace('{n}', '1000')} AS m FROM {{page_heads}})", per_page=True)
op("t2_document_header", "The first heading that fits.", f"SELECT file_id, page_number, heading, CASE WHEN heading IS NOT NULL THEN 0.85D END AS confidence FROM (SELECT file_id, page_number, {HEADING} AS heading FROM {{page_heads}})", per_page=True)
RESET = "CASE WHEN size(filter(edge, s -> " + " OR ".join(f"regexp_like(s, r'{p}')" for p in RESETS) + ")) > 0 THEN 0.7D END"
op("t3_page_number_reset", "A line that says page 1, among the first and last five of long pages.", f"SELECT file_id, page_number, {RESET} AS confidence FROM {{page_edges}}", per_page=True)
op("t4_white_space", "Pages of few words.", "SELECT file_id, page_number, word_count, CASE WHEN word_count < 50 THEN least(0.8D, 0.5D + 0.3D * (1 - word_count / 50D)) END AS confidence FROM {pages_seeded}", per_page=True)
op("t5_document_type", "The page's type by ordered rules.", f"SELECT file_id, page_number, {TYPE} AS document_type FROM {{page_heads}}", per_page=True)
op("t6_construction_pattern", "The first family of construction papers with two of its patterns.", f"SELECT file_id, page_number, family, {FAMILY_CONFIDENCE} AS confidence FROM (SELECT file_id, page_number, {FAMILY} AS family FROM {{page_heads}})", per_page=True)

#: Families of the cheap test: boost, keywords in lower case, heading patterns.
_QUICK = {
    "email": ("0.1", ["from:", "to:", "subject:", "date:", "sent:"], [r"^From:\s*", r"^To:\s*", r"^Subject:\s*"]),
    "invoice": ("0.05", ["invoice", "bill to", "ship to", "total", "amount due"], [r"Invoice\s*#", r"Invoice\s+Number"]),
    "rfi": ("0.15", ["rfi", "request for information", "response required", "clarification"], [r"RFI\s*#?\s*\d+", r"REQUEST\s+FOR\s+INFORMATION"]),
    "submittal": ("0.15", ["submittal", "shop drawing", "product data", "material sample"], [r"SUBMITTAL\s*#?\s*\d+", r"SUBMITTAL\s+TRANSMITTAL"]),
    "change_order": ("0.15", ["change order", "contract modification", "cost impact", "pco"], [r"CHANGE\s+ORDER\s*#?\s*\d+", r"PCO\s*#?\s*\d+"]),
    "contract": ("0.0", ["agreement", "terms and conditions", "whereas", "party", "obligations"], ["CONTRACT", "AGREEMENT"]),
    "letter": ("0.0", ["dear", "sincerely", "regards", "attention"], [r"^Dear\s+", r"RE:\s*", r"ATTENTION:\s*"]),
    "report": ("0.0", ["executive summary", "table of contents", "findings", "recommendations"], [r"TABLE\s+OF\s+CONTENTS", r"EXECUTIVE\s+SUMMARY"]),
}
_count = lambda ws: "(" + " + ".join(f"cast(contains(t, '{w}') AS int)" for w in ws) + ")"
_fits = {f: f"({_count(k)} >= 2 OR {hits('t', h)} >= 1)" for f, (_, k, h) in _QUICK.items()}
view("page_facts", "What the detectors go by of each page's text and record: types, headings, headers, words that hint; no text.", f"""
SELECT file_id, page_number, doc_id, lang, width, height, word_count, has_images, has_tables, ocr_confidence, n_issues, length(text) AS n_chars, {TYPE} AS kind, {FAMILY} AS family, {EMAIL_HITS.replace("{n}", "1000")} AS email, {HEADING} AS heading, {RESET} AS reset,
  CASE WHEN width <= 0 OR height <= 0 THEN 0D ELSE word_count / (width * height) END AS density, {any_of("t", POTENTIAL)} AS promising, {any_of("t", INDICATORS)} AS indicated, ({" OR ".join(_fits.values())}) AS fits,
  greatest({", ".join(f"CASE WHEN {c} THEN {_QUICK[f][0]}D ELSE 0D END" for f, c in _fits.items())}) AS boost,
  contains(l500, 'rfi') OR contains(l500, 'submittal') AS hints_construction, contains(l500, 'from:') AND contains(l500, 'to:') AS hints_email, contains(l500, 'invoice') OR contains(l500, 'purchase order') AS hints_business
FROM (SELECT e.*, lower(text) AS t FROM {{page_edges}} e)""", per_page=True)


def _quick_check(page_facts: DataFrame) -> DataFrame:
    pages = beside(page_facts.select("file_id", "page_number", "fits", "boost", F.col("n_chars").cast("double").alias("n")), ["n"])
    changes = F.abs(F.col("n") - F.col("before1.n")) / F.greatest("n", "before1.n", F.lit(1.0)) > 0.7
    return pages.select("file_id", "page_number", (F.col("fits") | F.coalesce(changes, F.lit(False))).alias("potential"), "boost")


def _first_last_or(pages: DataFrame, said: str) -> DataFrame:
    """First and last pages of files, and those of which `said` holds."""
    pages = beside(pages.select("file_id", "page_number", said), ["page_number"], back=1, ahead=1)
    return pages.select("file_id", "page_number", (F.col("before1").isNull() | F.col("after1").isNull() | F.col(said)).alias("potential"))


op("t7_quick_check", "Cheap test whether a model need look at a page: family words, headings, or a length unlike the page before.", _quick_check)
op("t8_potential_boundary", "First and last pages, and those with a word of the OCR plan's list.", lambda page_facts: _first_last_or(page_facts, "promising"))
op("t9_boundary_indicators", "First and last pages, and those with a word of the LLM plan's list.", lambda page_facts: _first_last_or(page_facts, "indicated"))
op("t10_type_hints", "What a file's first three pages hint at.", "SELECT file_id, bool_or(hints_construction) AS construction, bool_or(hints_email) AS email, bool_or(hints_business) AS business FROM {page_facts} WHERE page_number <= 3 GROUP BY file_id")
op("t11_truncate_words", "Text cut to 300 characters at a word, if one ends in the last fifth.", """
SELECT file_id, page_number, CASE WHEN length(text) <= 300 THEN text WHEN last > 240 THEN concat(left(text, cast(last AS int)), '...') ELSE concat(left(text, 300), '...') END AS cut
FROM (SELECT file_id, page_number, text, 300 - instr(reverse(left(text, 300)), ' ') AS last FROM {pages_seeded})
""", per_page=True)
op("t12_truncate_sentence", "Text cut to 300 characters after a sentence, else at a word.", r"""
SELECT file_id, page_number, CASE WHEN text = '' THEN '[EMPTY]' WHEN length(text) <= 300 THEN text WHEN stop > 210 THEN left(text, cast(stop + 1 AS int)) WHEN gap > 240 THEN concat(left(text, cast(gap AS int)), '...') ELSE concat(left(text, 300), '...') END AS cut
FROM (SELECT file_id, page_number, text, CASE WHEN instr(r, '.') + instr(r, chr(10)) = 0 THEN -1 ELSE 300 - least(CASE WHEN instr(r, '.') > 0 THEN instr(r, '.') ELSE 301 END, CASE WHEN instr(r, chr(10)) > 0 THEN instr(r, chr(10)) ELSE 301 END) END AS stop,
    CASE WHEN instr(r, ' ') = 0 THEN -1 ELSE 300 - instr(r, ' ') END AS gap
  FROM (SELECT file_id, page_number, text, reverse(left(text, 300)) AS r FROM {pages_seeded}))
""", per_page=True)
view("page_cuts", "The ends of each page that its neighbours and a model are shown.", "SELECT file_id, page_number, left(text, 500) AS current, left(text, 200) AS head, right(text, 200) AS tail FROM {pages_seeded}", per_page=True)


def _snippets(page_cuts: DataFrame) -> DataFrame:
    pages = beside(page_cuts, ["head", "tail"], back=1, ahead=1)
    return pages.select("file_id", "page_number", "current", F.coalesce("before1.tail", F.lit("N/A")).alias("previous"), F.coalesce("after1.head", F.lit("N/A")).alias("following"))


op("t13_text_snippets", "A page's beginning with its neighbours' edges.", _snippets)


def render(pages: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Every page in every template, by style. pages: file_id, page_number, and what stands in braces in the templates."""
    names = [c for c in pages.columns if any("{" + c + "}" in t for t in templates.values())]
    prompts = []
    for style, template in templates.items():
        prompt = F.lit(template)
        for c in names:
            prompt = F.replace(prompt, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
        prompts.append(F.struct(F.lit(style).alias("style"), prompt.alias("prompt")))
    return pages.select("file_id", "page_number", F.inline(F.array(*prompts)))


op("t14_prompt_render", "The question put to a model about every page, in each of the templates.", lambda page_cuts: render(page_cuts.withColumnRenamed("head", "text"), TEMPLATES))
op("t15_prompt_select", "The prompt style for the patterns seen.", """
SELECT file_id, page_number, CASE WHEN contains(t, 'rfi') OR contains(t, 'submittal') OR contains(t, 'change order') THEN 'detailed_construction' WHEN contains(t, 'from:') THEN 'few_shot' WHEN contains(t, 'invoice') OR contains(t, 'purchase order') OR contains(t, 'quot') THEN 'cot_financial'
  WHEN contains(t, 'dear') OR contains(t, 'contract') THEN 'structured' ELSE 'concise' END AS style FROM (SELECT file_id, page_number, lower(left(text, 500)) AS t FROM {pages_seeded})
""", per_page=True)
op("t16_prompt_adaptive", "The style that did best before, per file; the first by name of equals.", """
SELECT file_id, style, accuracy FROM (SELECT file_id, style, accuracy, row_number() OVER (PARTITION BY file_id ORDER BY accuracy DESC, style) AS r
  FROM (SELECT s.file_id, s.style, sum(CASE WHEN t.file_id IS NOT NULL THEN 1 ELSE 0 END) / cast(count(*) AS double) AS accuracy FROM {t15_prompt_select} s LEFT JOIN {truth} t ON s.file_id IS NOT DISTINCT FROM t.file_id AND s.page_number = t.start_page GROUP BY s.file_id, s.style)) WHERE r = 1
""")
op("t17_prompt_optimize", "A prompt with blank runs collapsed, its JSON instruction, and a length limit.", r"""
SELECT file_id, page_number, CASE WHEN length(p) > 14000 THEN left(p, 14000) ELSE p END AS prompt FROM (SELECT file_id, page_number, concat(regexp_replace(regexp_replace(text, r'\n[ \t\n]*\n', chr(10)), r'[ \t]+', ' '), chr(10), 'Reply with JSON only.') AS p FROM {pages_seeded})
""", per_page=True)
op("t18_llm_json_parse", "Replies of a model: the JSON in them, with defaults.", r"""
SELECT event_id, coalesce(get_json_object(j, '$.is_boundary') = 'true', false) AS is_boundary, coalesce(cast(get_json_object(j, '$.confidence') AS double), 0.5D) AS confidence, get_json_object(j, '$.document_type') AS document_type
FROM (SELECT event_id, regexp_extract(reply, r'(?s)\{.*\}', 0) AS j FROM {json_replies}) WHERE j <> ''
""")
op("t19_llm_type_map", "Type names of a model in the engine's terms.", f"SELECT event_id, CASE lower(document_type) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in LLM_TYPES.items())} ELSE 'other' END AS document_type FROM {{t18_llm_json_parse}}")
op("t20_llm_text_fallback", "Replies without JSON: words and numbers decide.", r"""
SELECT event_id, (contains(lower(reply), 'yes') OR contains(lower(reply), 'boundary: true')) AS is_boundary, coalesce(cast(nullif(regexp_extract(reply, r'confidence[^0-9]*([0-9]+\.[0-9]+)', 1), '') AS double), 0.5D) AS confidence FROM {plain_replies}
""")
op("t21_prepare_page_text", "Lines trimmed, blank ones gone, headings before the rest, 400 characters at most.", r"""
SELECT file_id, page_number, left(array_join(concat(filter(l, s -> regexp_like(s, r'^[A-Z][^a-z]*$') OR contains(s, ':')), filter(l, s -> NOT (regexp_like(s, r'^[A-Z][^a-z]*$') OR contains(s, ':')))), chr(10)), 400) AS prepared
FROM (SELECT file_id, page_number, filter(transform(split(text, r'\n'), s -> regexp_replace(regexp_replace(s, r'[ \t]+', ' '), r'^ | $', '')), s -> s <> '') AS l FROM {pages_seeded})
""", per_page=True)
