"""Made-up inputs: what no given table holds, by arithmetic on ids of the rows that are given.

Queries over the base tables need pages with headings, visual features, blocks, ground truth, tasks, a model's replies;
these stand for them, so that operators and their SQL can be compared at any size. Callers hand in frames of their own.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.windows import beside, ranges
from leafbound.plans.ops import view

view("pages_seeded", "The same pages, with headings that documents of the trade have.", r"""
SELECT file_id, page_number, doc_id, width, height, lang, text, cast(size(regexp_extract_all(text, r'[^ \t\n\r\f]+', 0)) AS int) AS word_count,
  (doc_id % 6 = 0) AS has_images, (doc_id % 5 = 1) AS has_tables,
  CASE WHEN doc_id % 8 = 0 THEN NULL ELSE cast(doc_id % 101 AS double) / 100 END AS ocr_confidence, cast(doc_id % 4 AS int) AS n_issues
FROM (SELECT file_id, page_number, doc_id, width, height, lang, concat(CASE doc_id % 12
    WHEN 0 THEN concat('From: a@b.org', chr(10), 'To: c@d.org', chr(10), 'Subject: site visit', chr(10), 'Date: 2024-03-05', chr(10), 'Dear all, please see attached. Regards', chr(10))
    WHEN 1 THEN concat('INVOICE #', cast(doc_id AS string), chr(10), 'Bill to: client', chr(10), 'Total amount $1,200.50 payment due 03/04/2024', chr(10))
    WHEN 2 THEN concat('REQUEST FOR INFORMATION #', cast(doc_id AS string), chr(10), 'RFI #', cast(doc_id AS string), ' response required by May 3, 2024', chr(10))
    WHEN 3 THEN concat('SUBMITTAL #', cast(doc_id AS string), chr(10), 'SHOP DRAWING and PRODUCT DATA', chr(10))
    WHEN 4 THEN concat('COST PROPOSAL #', cast(doc_id AS string), chr(10), 'CHANGE ORDER # 7 COST IMPACT', chr(10))
    WHEN 5 THEN concat('Page 1 of 3', chr(10))
    WHEN 6 THEN concat('APPLICATION FOR PAYMENT', chr(10), 'SCHEDULE OF VALUES', chr(10))
    WHEN 7 THEN concat('Dear Sir, this contract and agreement between the parties, section 4 and article 5. Sincerely', chr(10))
    WHEN 8 THEN concat('DAILY REPORT', chr(10), 'WEATHER CONDITIONS and MANPOWER ON SITE', chr(10))
    WHEN 9 THEN concat('MEETING MINUTES', chr(10), 'ATTENDEES: four. ACTION ITEMS: none. Quotation # 12', chr(10))
    ELSE '' END, text) AS text
  FROM {pages_doc})
""", per_page=True)

view("ocr_pages", "Pages with the wear of scanning: doubled marks, split words, confused letters.", r"""
SELECT file_id, page_number, doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'xx' END AS expected, concat(CASE doc_id % 8 WHEN 0 THEN concat('From: a @ grnail . com', chr(10), 'To: c@d.org', chr(10), 'Subject: rn tl1e thec ~~~ ', chr(10)) WHEN 1 THEN concat('lnvoice ||| INVOICE # 77 total $ 1,200.50 due 2024-03-05 @@@', chr(10))
  WHEN 2 THEN 'th e cl vv O l 1 and t o work ( now ) , "  quoted  " well-' WHEN 3 THEN concat('section 4 ARTICLE 5 whereas party shall', chr(10), chr(10), chr(10), chr(10), chr(10), 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx   #### ##### ----', chr(10)) WHEN 4 THEN 'end.Next,then;so   I1 11 Il ____ ' ELSE '' END,
  text) AS text FROM {pages_doc}
""", per_page=True)

view("visual", "Visual features of each page, by arithmetic on its document's id.", r"""
SELECT file_id, page_number, doc_id, width, height, word_count, text,
  cast(1 + doc_id % 3 AS int) AS num_columns, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 8 + (doc_id % 5) * 1.5D END AS font_size, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('family', cast(doc_id % 3 AS string)) END AS font_family,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'left' ELSE 'justify' END AS alignment, concat('bg', cast(doc_id % 2 AS string)) AS background, concat('ink', cast(doc_id % 3 AS string)) AS ink, (doc_id % 4 = 0) AS color_images,
  (doc_id % 3 = 0) AS has_header, (doc_id % 4 < 2) AS has_footer, CASE WHEN doc_id % 3 = 0 THEN concat('head', cast(doc_id % 5 AS string)) END AS header_text, CASE WHEN doc_id % 4 < 2 THEN concat('foot', cast(doc_id % 6 AS string)) END AS footer_text,
  cast(doc_id % 4 AS int) AS num_images, cast(doc_id % 5 % 4 AS int) AS num_tables, cast(doc_id % 3 AS int) AS num_charts, (doc_id % 17 = 0) AS has_logo, (doc_id % 19 = 0) AS has_signature,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE cast(20 + doc_id * 7 % 60 AS double) END AS margin_top, cast(20 + doc_id * 11 % 50 AS double) AS margin_bottom, cast(doc_id * 13 % 70 AS double) AS margin_left, cast(10 + doc_id * 17 % 60 AS double) AS margin_right,
  CASE WHEN doc_id % 13 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, CASE WHEN doc_id % 13 = 0 THEN 792D / 612D ELSE 612D / 792D END AS aspect, cast(doc_id % 100 AS double) / 100 AS boundary_score,
  array(CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE 'list' END, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END, CASE WHEN doc_id % 5 = 0 THEN 'picture' ELSE 'caption' END) AS layout_types,
  cast(size(filter(sequence(1, 4 + doc_id % 3), b -> (doc_id + b) % 9 = 0)) AS int) AS n_rules
FROM {pages_doc}
""", per_page=True)

view("blocks", "Layout blocks of each page: four to six boxes by arithmetic on its document's id.", r"""
SELECT file_id, page_number, b, CASE (doc_id + b) % 7 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'picture' WHEN 3 THEN 'chart_classification' ELSE 'text' END AS kind,
  cast((doc_id * 31 + b * 173) % 480 AS double) AS x, cast((doc_id * 17 + b * 139) % 700 AS double) AS y, CASE WHEN (doc_id + b) % 9 = 0 THEN 560D ELSE cast(40 + (doc_id + b * 37) % 90 AS double) END AS w, CASE WHEN (doc_id + b) % 9 = 0 THEN 2D ELSE cast(10 + (doc_id * 3 + b * 29) % 60 AS double) END AS h,
  concat('block ', cast(b AS string)) AS block_text, 8 + (doc_id + b) % 4 * 2D AS font_size, concat('f', cast((doc_id + b) % 3 AS string)) AS font_family
FROM (SELECT file_id, page_number, doc_id, explode(sequence(1, 4 + doc_id % 3)) AS b FROM {pages_doc})
""")


def _truth(pages_doc: DataFrame, labels: DataFrame) -> DataFrame:
    pages = pages_doc.select("file_id", "page_number", "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    pages = beside(pages, ["page_number"], ahead=1).withColumn("last", F.col("after1").isNull())
    pages = pages.withColumn("starts", (F.col("page_number") == 1) | ((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0)))
    kind = F.element_at(F.array(*map(F.lit, ("Email", "Invoice", "Request for Information", "Submittal"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return ranges(pages, "starts", "last").select("file_id", "start_page", "end_page", kind.alias("kind"))


view("truth", "Ground truth: a document starts where a labelled document of quality 1 stands, and on page 1.", _truth)


view("tasks", "Processing tasks made of events: a user's events are one task's history.", r"""
SELECT event_id AS task_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'low' ELSE 'normal' END AS priority,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, value
FROM {events}
""")


view("feedback", "What reviewers said of pages: labels as verdicts.", "SELECT p.file_id, p.page_number, (l.quality = 1) AS is_boundary FROM {pages_doc} p JOIN {labels} l ON p.doc_id = l.doc_id")
view("llm_verdicts", "A model's verdicts on the ambiguous pages, by arithmetic.", "SELECT file_id, page_number, (page_number % 3 <> 0) AS yes, 0.5D + page_number % 5 / 10D AS confidence, CASE page_number % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'report' ELSE 'letter' END AS document_type FROM {b15_ambiguous_cases}")

_ASK = "\nPage {page_number}: {text}\nAnswer in JSON with is_boundary, confidence, reasoning, document_type."
#: Prompt templates in five styles and for four trades, to render pages with; callers bring their own.
TEMPLATES = {
    "concise": "Does a new document start here?" + _ASK,
    "structured": "Weigh headers, layout and topic, then decide whether a new document starts." + _ASK,
    "few_shot": "Example: a page with From: and Subject: lines starts an e-mail." + _ASK,
    "cot_financial": "Reason step by step over numbers, dates and parties." + _ASK,
    "detailed_construction": "Construction papers: look at RFI, submittal and change order numbers." + _ASK,
    "trade_construction": "You know building sites. Does a new request, submittal, change order, report or minutes begin?" + _ASK,
    "trade_email": "Does a new message begin, or does an earlier one of the chain go on?" + _ASK,
    "trade_financial": "Does a new invoice, order, quotation or statement begin? Numbers and totals tell." + _ASK,
    "trade_mixed": "Any kind of paper may follow any other. Does one begin here?" + _ASK,
}

view("uploads", "Files that are handed in, with made-up sizes and suffixes.", "SELECT page_id, url, page_id * 37 % 800 AS size_mb, CASE WHEN page_id % 3 = 2 THEN 'txt' ELSE 'pdf' END AS suffix FROM {pages}")

view("json_replies", "Replies of a model with JSON in most of them.", r"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no json here' ELSE concat('Sure. {"is_boundary": ', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(', "confidence": 0.', cast(event_id % 9 + 1 AS string)) END, ', "document_type": "', CASE event_id % 5 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'RFI' WHEN 2 THEN 'purchase order' WHEN 3 THEN 'memo' ELSE 'email' END, '"} done') END AS reply FROM {events}""")
view("plain_replies", "Replies of a model without JSON.", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('Yes, confidence 0.', cast(event_id % 9 + 1 AS string)) WHEN 1 THEN 'No new document.' ELSE 'boundary: true' END AS reply FROM {events}")


def stand_in(prompt: str) -> str:
    """Answers like a model, by words of the prompt."""
    text = prompt.split("\n", 1)[-1].lower()
    kind = next((k for k in ("invoice", "rfi", "contract", "proposal") if k in text), "letter")
    return f'{{"is_boundary": {str(kind != "letter" or "dear" in text).lower()}, "confidence": 0.{6 + len(text) % 4}, "document_type": "{kind}"}}'

view("vlm_pages", "What a vision model says of pages: the given vectors as signatures, the rest by arithmetic on their ids.", """
SELECT label AS file_id, vec_id AS page_number, vec_id % 3 AS layout, vec_id % 2 AS header, vec_id % 4 < 2 AS same_footer, vec_id % 3 AS columns, vec_id % 10 / 10D AS whitespace, transform(embedding, v -> cast(v AS double)) AS signature FROM {embeddings}""")
view("likeness", "How like the page before each page's text and picture are, by arithmetic.", "SELECT file_id, page_number, cast(doc_id * 7 % 100 AS double) / 100 AS text_likeness, boundary_score AS visual_likeness FROM {visual}", per_page=True)
