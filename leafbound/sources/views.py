"""Page streams made from the base tables, each keyed by (file_id, page_number)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.plans.ops import op, view
from leafbound.sources.pages import page_rows

WORDS = r"size(regexp_extract_all({0}, r'[^ \t\n\r\f]+', 0))"

view("pages_doc", "Documents of a source in order of id, as the pages of one file.", lambda documents: page_rows(documents), per_page=True)

view("page_heads", "Pages with the beginnings that the detectors read, cut and put into lower case once.", """
SELECT p.*, left(text, 500) AS h500, left(text, 1000) AS h1000, lower(left(text, 500)) AS l500, lower(left(text, 1000)) AS l1000 FROM {pages_seeded} p
""", per_page=True)

view("page_edges", "The same with the lines at which a page number stands: first and last five of long pages, else all, trimmed.", r"""
SELECT h.*, transform(CASE WHEN size(lines) > 10 THEN concat(slice(lines, 1, 5), slice(lines, -least(5, size(lines)), 5)) ELSE lines END, s -> regexp_replace(s, r'^\s+|\s+$', '')) AS edge FROM (SELECT p.*, split(text, r'\n') AS lines FROM {page_heads} p) h
""", per_page=True)

op("s1_pages_scan", "Pages of each file in order, with word counts and whether lines look like tables.", r"""
SELECT file_id, page_number, word_count, cast(length(text) AS bigint) AS n_chars, (contains(text, chr(9)) OR contains(text, '  ')) AS has_tables FROM {pages_doc}
""", per_page=True)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """The pages from first to last of each file; a last page beyond a file's end is its end."""
    return pages.where(F.col("page_number").between(first, last))


op("s2_page_range", "Pages 3 to 7 of each file.", lambda pages_doc: page_range(pages_doc, 3, 7).select("file_id", "page_number", "word_count"))
op("s3_convert", "A file's text as one string's length, pages kept apart by form feeds.", "SELECT file_id, count(*) AS n_pages, cast(sum(length(text)) + count(*) - 1 AS bigint) AS n_chars FROM {pages_doc} GROUP BY file_id")
op("s5_ground_truth", "Page ranges written 's-e' or 's', read back.", r"""
SELECT file_id, cast(element_at(split(r, '-'), 1) AS int) AS start_page, cast(CASE WHEN contains(r, '-') THEN element_at(split(r, '-'), 2) ELSE r END AS int) AS end_page, kind
FROM (SELECT file_id, kind, CASE WHEN start_page = end_page THEN cast(start_page AS string) ELSE concat(cast(start_page AS string), '-', cast(end_page AS string)) END AS r FROM {truth})
""")
op("s6_file_metadata", "What is known of a file: pages, first and last document, languages.", "SELECT file_id, count(*) AS n_pages, min(doc_id) AS first_doc, max(doc_id) AS last_doc, array_join(array_sort(collect_set(lang)), ',') AS langs FROM {pages_doc} GROUP BY file_id")
op("s7_text_page", "Embedded text of a page: words, images, tables, and whether it is mostly empty or needs review.", r"""
SELECT file_id, page_number, word_count, has_images, has_tables, (word_count < 50) AS mostly_empty, (coalesce(ocr_confidence < 0.6D, false) OR n_issues > 2) AS needs_review FROM {pages_seeded}
""", per_page=True)
