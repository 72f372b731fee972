"""Scores of how well a page's text was read."""

from leafbound.plans.ops import op, view

#: Common English words, as one text.
COMMON = (
    "a about after all also an and any are as at back be because been but by can come could day do each even first for from get give go good had has have he her him his how i if in into is it its just know like long "
    "look make many me more most my new no not now of on one only or other our out over people said say see she so some take than that the their them then there these they thing think this time to two up us use want "
    "was way we well were what when which who will with work would write year you your"
).split()
#: Stems of common pairs of words, and what dates, amounts and addresses look like.
STEMS = "the and of to in is was".split()
DATES = [r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}", r"(?:^|[^\p{L}\p{N}_])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}"]
CURRENCY, AMOUNT, EMAIL = r"[$€£¥]\s*\d+[,.\d]*", r"[$€£¥]\s*[\d,]+\.?\d*", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: Links, telephone numbers, percentages.
URL, PHONE, PERCENT = r"https?://(?:www\.)?[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"[\+\(]?[1-9][0-9 .\-\(\)]{8,}[0-9]", r"\d+\.?\d*\s*%"
PHRASES = ["dear", "regards", "sincerely", "thank you", "please", "attached"]
INVOICE = ["invoice", "bill", "total", "amount", "payment", "due"]
LEGAL = ["agreement", "party", "parties", "whereas", "therefore", "shall", "hereby", "terms", "conditions"]
#: A character of a word.
W = r"[\p{L}\p{N}_]"

#: A whole word of lower-case text; what is compared first is cheap, as in all patterns here that run over whole texts.
whole = lambda w: rf"(?=[{w[0]}])(?<![a-z0-9_]){w}(?![a-z0-9_])"
count = lambda col, p: f"size(regexp_extract_all({col}, r'{p}', 0))"
without = lambda col, p: f"length(regexp_replace({col}, r'{p}', ''))"
#: Addresses in a text; a run of characters is tried once, from its beginning or the end of the address before.
_emails = r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++" + EMAIL[EMAIL.index("@"):]
EMAILS = f"CASE WHEN contains(text, '@') THEN {count('text', _emails)} ELSE 0 END"
#: A word without four consonants in a row has a vowel for five letters, but for these of six, seven and eleven letters.
_c, _v = "[bcdfghjklmnpqrstvwxyz]", "[aeiou]"
GIBBERISH = rf"(length(w) > 5 AND regexp_like(w, r'{_c}{{4}}|([a-z])\1\1|^{_c}{{2,3}}{_v}{_c}{{2,3}}$|^{_c}{{3}}{_v}{_c}{{3}}{_v}{_c}{{3}}$'))"

_common = ", ".join(f"'{w}'" for w in COMMON)
#: Stems before another word. A stem that directly follows the same stem belongs to the pair that this begins.
_pairs = count("low", rf"(?=[{''.join(sorted({s[0] for s in STEMS}))}])(?<!{W})({'|'.join(STEMS)})(?=\s+{W})(?:\s+\1(?=\s+{W}))?")
#: Marks in a row, counted only where there are any.
_runs = " + ".join(f"CASE WHEN contains(text, '{c * n}') THEN {count('text', f'[{c}]{{{n},}}')} ELSE 0 END" for c, n in (("|", 3), ("~", 3), ("#", 5), ("@", 3)))
view("page_figures", "What all scores of a page go by, in one pass over its text: classes of characters, kinds of words, sentences, lines.", rf"""
SELECT *, n - size(other) AS common, size(filter(other, w -> length(w) BETWEEN 2 AND 15)) AS fair, size(filter(other, w -> length(w) > 20)) AS long, size(filter(words, w -> {GIBBERISH})) AS gibberish,
  CASE WHEN n = 0 THEN false ELSE exists(sequence(fifth + 1, n, fifth + 1), i -> coalesce(try_element_at(sorted, cast(array_position(sorted, element_at(sorted, i)) AS int) + fifth) = element_at(sorted, i), false)) END AS repetitive,
  size(sentences) AS n_sentences, size(filter(sentences, s -> regexp_like(s, r'^\s*+\p{{Lu}}'))) AS capital, size(filter(sentences, s -> regexp_like(s, r'^\s*+(?:\S++\s++){{2}}\S') AND NOT (length(s) > 100 AND regexp_like(s, r'^\s*+(?:\S++\s++){{50}}\S')))) AS even, size(filter(lines, s -> NOT regexp_like(s, r'\S'))) AS blank, size(lines) AS n_lines
FROM (SELECT *, sort_array(words) AS sorted, filter(words, w -> w NOT IN ({_common})) AS other, size(words) AS n, cast(floor(size(words) / 5D) AS int) AS fifth FROM (
SELECT file_id, page_number, expected, text, length(text) AS n_chars, length(text) - length(rest) AS letters, length(rest) - {without("rest", r"\p{Nd}+")} AS digits, length(rest) - {without("rest", r"[ \t\n\r\f\x0B\x1c-\x1f\x85\xa0]+")} AS spaces,
  length(rest) - {without("rest", r"[!-/:-@\[-`{-~]+")} AS marks, {count("rest", r"[\x01-\x08\x0B\x0C\x0E-\x1F]")} + {_runs} AS suspicious,
  regexp_extract_all(low, r'(?=[a-z])(?<!{W})[a-z]++(?!{W})', 0) AS words, CASE WHEN expected <> 'en' THEN 0 ELSE {_pairs} END AS pairs, contains(text, '   ') AS wide, {count("text", r"[.!?,][a-zA-Z]")} AS tight, split(text, r'[.!?]+') AS sentences, split(text, r'\n') AS lines
FROM (SELECT file_id, page_number, expected, text, lower(text) AS low, regexp_replace(text, r'\p{{L}}+', '') AS rest FROM <ocr_pages>)))""".replace("<ocr_pages>", "{ocr_pages}"), per_page=True)
_odd = "(n_chars - letters - digits - spaces - marks) / cast(n_chars AS double)"
_mixed = f"(1 - CASE WHEN {_odd} > 0.1D THEN least({_odd} * 2, 0.5D) ELSE 0D END - CASE WHEN suspicious > 0 THEN least(suspicious / cast(n_chars AS double) * 10, 0.5D) ELSE 0D END)"
_chars = f"CASE WHEN n_chars = 0 THEN 0D ELSE greatest(0D, CASE WHEN letters / cast(n_chars AS double) BETWEEN 0.6D AND 0.85D THEN least(1D, {_mixed} + 0.1D) ELSE {_mixed} END) END"
op("q1_char_confidence", "How the characters are mixed.", f"SELECT file_id, page_number, {_chars} AS confidence FROM {{page_figures}}", per_page=True)
_word = "CASE WHEN n = 0 THEN 0D ELSE least(1D, (common + 0.3D * fair - 0.2D * long) / n * CASE WHEN gibberish > n * 0.1D THEN 0.8D ELSE 1D END * CASE WHEN repetitive THEN 0.7D ELSE 1D END) END"
op("q2_word_confidence", "How many words are known or of fair length.", f"SELECT file_id, page_number, bround({_word}, 9) AS confidence FROM {{page_figures}}", per_page=True)
op("q3_gibberish", "Words that can't be words: runs of consonants, tripled letters, hardly a vowel.", "SELECT file_id, page_number, cast(gibberish AS bigint) AS gibberish, cast(n AS bigint) AS n_words FROM {page_figures}", per_page=True)
_structure = "CASE WHEN text = '' THEN 0D ELSE (least((0.3D * capital + 0.7D * even) / n_sentences, 1D) + 1 - CASE WHEN wide THEN 0.2D ELSE 0D END - CASE WHEN tight > 5 THEN 0.3D ELSE 0D END + CASE WHEN blank / cast(n_lines AS double) > 0.5D THEN 0.5D ELSE 1D END) / 3 END"
op("q4_structure_confidence", "Sentences, spacing and lines as they should be.", f"SELECT file_id, page_number, bround({_structure}, 9) AS confidence FROM {{page_figures}}", per_page=True)
_language = "CASE WHEN expected <> 'en' THEN 0.5D WHEN n = 0 THEN 0D WHEN pairs > 0 THEN (common / cast(n AS double) + least(pairs / 20D, 1D)) / 2 ELSE common / cast(n AS double) END"
op("q5_language_confidence", "How English the text is; other languages are neutral.", f"SELECT file_id, page_number, bround({_language}, 9) AS confidence FROM {{page_figures}}", per_page=True)
_dates = " + ".join(count("text", d) for d in DATES)
op("q6_pattern_confidence", "Addresses, dates and amounts, null where there are none.", f"""
SELECT file_id, page_number, CASE WHEN emails > 0 THEN 1D END AS email, CASE WHEN dates > 0 THEN least(dates / 5D, 1D) END AS dates, CASE WHEN amounts > 0 THEN least(amounts / 3D, 1D) END AS currency
FROM (SELECT file_id, page_number, {EMAILS} AS emails, {_dates} AS dates, {count("text", CURRENCY)} AS amounts FROM {{ocr_pages}})""", per_page=True)
_words = lambda ws: "(" + " + ".join(f"cast(contains(low, '{w}') AND regexp_like(low, r'{whole(w)}') AS int)" for w in ws) + ")"
op("q7_document_confidence", "Signs of an e-mail, an invoice, a contract, scored as each.", rf"""
SELECT file_id, page_number, bround(({" + ".join(f"cast(contains(low, '{h}:') AND regexp_like(text, r'(?im)^{h}:') AS int)" for h in ("from", "to", "subject", "date"))}) / 4D / 3 + least({EMAILS} / 2D, 1D) / 3 + least(({" + ".join(f"cast(contains(low, '{p}') AS int)" for p in PHRASES)}) / 3D, 1D) / 3, 9) AS email,
  bround((least({_words(INVOICE)} / 3D, 1D) + least({count("text", AMOUNT)} / 3D, 1D) + CASE WHEN contains(low, 'invoice') AND regexp_like(text, r'(?i)invoice\s*+#?+\s*+:?+\s*+\d') THEN 1D ELSE 0D END) / 3, 9) AS invoice,
  bround((least({_words(LEGAL)} / 4D, 1D) + least({count("text", r"(?i)(?:section|article|clause)\s+\d+")} / 3D, 1D)) / 2, 9) AS contract, 0.5D AS other FROM (SELECT file_id, page_number, text, lower(text) AS low FROM <ocr_pages>)""".replace("<ocr_pages>", "{ocr_pages}"), per_page=True)
view("page_quality", "All scores of a page, its overall confidence and what is wrong with it.", rf"""
SELECT file_id, page_number, text, chars, words, structure, language, CASE WHEN text = '' THEN 0D ELSE 0.25D * chars + 0.3D * words + 0.2D * structure + 0.25D * language END AS overall,
  CASE WHEN text = '' THEN array('no_text_detected') ELSE filter(array(CASE WHEN chars < 0.7D THEN 'suspicious_characters' END, CASE WHEN words < 0.6D THEN 'low_word_recognition' END, CASE WHEN structure < 0.6D THEN 'poor_text_structure' END, CASE WHEN language < 0.5D THEN 'language_detection_failed' END,
    CASE WHEN regexp_like(text, r'[|~#@]{{3,}}') THEN 'ocr_artifacts_detected' END, CASE WHEN regexp_like(text, r'(?<!{W}){W}{{25}}') THEN 'word_boundary_errors' END, CASE WHEN contains(text, chr(10) || chr(10) || chr(10)) AND {count("text", r"\n\n\n")} > 3 THEN 'excessive_line_breaks' END, CASE WHEN contains(text, 'rn') AND regexp_like(text, r'(?=r)(?<!{W})rn(?!{W})') THEN 'rn_to_m_errors' END,
    CASE WHEN regexp_like(text, r'(?=[0O])(?<!{W})[0O](?!{W})') THEN 'zero_o_confusion' END, CASE WHEN regexp_like(text, r'(?=[Il1])(?<!{W})[Il1]{{2,}}+(?!{W})') THEN 'i_l_1_confusion' END), x -> x IS NOT NULL) END AS issues
FROM (SELECT file_id, page_number, text, {_chars} AS chars, bround({_word}, 9) AS words, bround({_structure}, 9) AS structure, bround({_language}, 9) AS language FROM <page_figures>)""".replace("<page_figures>", "{page_figures}"), per_page=True)
_bucket = "CASE WHEN text = '' THEN 'empty' WHEN overall >= 0.9D THEN 'excellent' WHEN overall >= 0.8D THEN 'good' WHEN overall >= 0.6D THEN 'fair' WHEN overall >= 0.4D THEN 'poor' ELSE 'very_poor' END"
view("page_scores", "The same without the text, for what needs page numbers: texts aren't dealt out.", f"SELECT file_id, page_number, chars, words, structure, language, overall, size(issues) AS n_issues, text <> '' AS read, {_bucket} AS quality FROM {{page_quality}}", per_page=True)
op("q8_overall_confidence", "The page's confidence.", "SELECT file_id, page_number, bround(overall, 6) AS confidence FROM {page_quality}", per_page=True)
op("q9_quality_bucket", "Excellent to very poor.", f"SELECT file_id, page_number, {_bucket} AS quality FROM {{page_quality}}", per_page=True)
op("q10_issues", "What is wrong with a page, in fixed order.", "SELECT file_id, page_number, array_join(issues, ',') AS issues FROM {page_quality}", per_page=True)
op("q11_suggestions", "What may help; manual review always.", """
SELECT file_id, page_number, array_join(filter(array(CASE WHEN array_contains(issues, 'suspicious_characters') THEN 'improve scan quality' END, CASE WHEN array_contains(issues, 'low_word_recognition') THEN 'check language settings' END, CASE WHEN array_contains(issues, 'poor_text_structure') THEN 'adjust layout analysis' END,
  CASE WHEN array_contains(issues, 'ocr_artifacts_detected') THEN 'apply preprocessing' END, CASE WHEN array_contains(issues, 'word_boundary_errors') THEN 'adjust word segmentation' END, 'manual review'), x -> x IS NOT NULL), '; ') AS suggestions FROM {page_quality}""", per_page=True)
op("q12_metrics", "Characters, words, lines and vocabulary of a page.", r"""
SELECT file_id, page_number, cast(length(text) AS bigint) AS n_chars, cast(size(w) AS bigint) AS n_words, cast(size(split(text, r'\n')) AS bigint) AS n_lines, cast(size(array_distinct(transform(w, x -> lower(x)))) AS bigint) AS n_distinct, CASE WHEN size(w) > 0 THEN bround(length(array_join(w, '')) / cast(size(w) AS double), 6) END AS mean_length
FROM (SELECT file_id, page_number, text, regexp_extract_all(text, r'[^ \t\n\r\f]+', 0) AS w FROM {ocr_pages})""", per_page=True)
op("q13_quality_summary", "Of each file: mean confidence, pages to review, issues found.", "SELECT file_id, bround(avg(overall), 6) AS mean_confidence, count_if(overall > 0 AND overall < 0.7D) AS n_review, array_join(transform(array_sort(filter(collect_list(CASE WHEN overall > 0 AND overall < 0.7D THEN page_number END), x -> x IS NOT NULL)), x -> cast(x AS string)), ',') AS review, cast(sum(n_issues) AS bigint) AS n_issues FROM {page_scores} GROUP BY file_id")
op("q14_page_report", "One page's scores: page 3 of each file.", "SELECT file_id, page_number, bround(chars, 6) AS chars, bround(words, 6) AS words, bround(structure, 6) AS structure, bround(language, 6) AS language, quality FROM {page_scores} WHERE page_number = 3")
op("q15_enhance_page", "Pages whose text is to be repaired: too unsure, and not empty.", "SELECT file_id, page_number, (read AND overall < 0.6D) AS repair, CASE WHEN overall < 0.4D THEN 'aggressive' WHEN overall < 0.6D THEN 'normal' ELSE 'none' END AS mode FROM {page_scores}", per_page=True)
op("q16_processing_stats", "Counters over all pages.", "SELECT count(*) AS pages, count_if(read) AS read, count_if(overall < 0.6D) AS low, bround(avg(overall), 6) AS mean_confidence FROM {page_scores}")
op("q17_validators", "Addresses, links, telephone numbers, dates, amounts and percentages found.", rf"""
SELECT file_id, page_number, cast({EMAILS} AS bigint) AS emails, cast({count("text", URL)} AS bigint) AS urls, cast({count("text", PHONE)} AS bigint) AS phones, cast({_dates} AS bigint) AS dates, cast({count("text", CURRENCY)} AS bigint) AS amounts, cast({count("text", PERCENT)} AS bigint) AS percentages FROM <ocr_pages>""".replace("<ocr_pages>", "{ocr_pages}"), per_page=True)
