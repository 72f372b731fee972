"""Page queries at size: means that meet a threshold, patterns over long runs, the same values as by the plain patterns."""

import random
import re
import time

from leafbound.operators import quality, repair
from leafbound.plans.ops import apply
from leafbound.plans.registry import QUERIES


def ocr(spark, *texts, expected="en"):
    return spark.createDataFrame([("f", i + 1, i, expected, t) for i, t in enumerate(texts)], "file_id string, page_number int, doc_id long, expected string, text string")


def test_f1_document_confidence_by_plain_patterns(spark):
    texts = [
        "From: a@b.com1@c.de x@y\nSUBJECT: it\nto: be", "invoice_ total, amount_due due. INVOICE  # : 12 $ 1,200.5 €3", "a@b..com@c.org %@a.bc", "the party's terms; parties shall not. Section 4 clause\n5", "billed bill", "İnvoice duе due\n",
        "x@y.zz@q.rs whereas", "", "conditions", "dear Regards please", "to:\r\nfrom:",
    ]
    word = lambda t, w: bool(re.search(rf"(^|[^a-z0-9_]){w}([^a-z0-9_]|$)", t.lower()))

    def plain(t):
        heads = sum(bool(re.search(rf"^{h}:", t, re.I | re.M | re.A)) for h in ("from", "to", "subject", "date")) / 4 / 3
        email = heads + min(len(re.findall(quality.EMAIL, t)) / 2, 1) / 3 + min(sum(p in t.lower() for p in quality.PHRASES) / 3, 1) / 3
        number = bool(re.search(r"invoice\s*#?\s*:?\s*\d+", t, re.I | re.A))
        invoice = (min(sum(word(t, w) for w in quality.INVOICE) / 3, 1) + min(len(re.findall(quality.AMOUNT, t, re.A)) / 3, 1) + number) / 3
        contract = (min(sum(word(t, w) for w in quality.LEGAL) / 4, 1) + min(len(re.findall(r"(?:section|article|clause)\s+\d+", t, re.I | re.A)) / 3, 1)) / 2
        return [round(x, 6) for x in (email, invoice, contract)]

    got = apply("q7_document_confidence", ocr_pages=ocr(spark, *texts)).orderBy("page_number").collect()
    assert [[round(r[k], 6) for k in ("email", "invoice", "contract")] for r in got] == [plain(t) for t in texts]


def test_f1_long_runs_take_linear_time(spark):
    began = time.time()
    rows = apply("q7_document_confidence", ocr_pages=ocr(spark, "a" * 400_000 + " @")).collect()
    assert rows[0]["email"] == 0 and time.time() - began < 20


def test_f2_profile_of_a_mean_on_a_threshold(spark):
    """A mean of 0.7 exactly, of which the sum of doubles falls short in this order."""
    marks, draw = [], random.Random(9)
    while not marks or sum_in_order(marks) / 1000 >= 0.7:
        whole = [draw.randint(40, 100) for _ in range(999)]
        marks = [x / 100 for x in [*whole, 70_000 - sum(whole)]]
    pages = spark.createDataFrame([("f", i + 1, i, x, False) for i, x in enumerate(marks)], "file_id string, page_number int, doc_id long, ocr_confidence double, has_tables boolean").coalesce(1)
    assert apply("file_quality", pages_seeded=pages).first()["quality"] == 0.7
    assert apply("o14_generate_config", pages_seeded=pages).first()["level"] == "good"


def sum_in_order(values):
    total = 0.0
    for x in values:
        total += x
    return total


def test_f6_to_f13_page_figures_by_plain_patterns(spark):
    texts = [
        "the the the the cat. of the of of in the\tand", "The cat and the dog. a\nb the", "", "12 ab_c x9 über naïve w\u00f6rd bcdfgh aaab eee strength rhythms", "||| |a|| ~~~ ##### #### @@@ \x02\x03", "rn O 0 Il 11 trn rn_ l1l I1",
        "a" * 24 + " " + "b" * 25, "one two three. one two\nthree four!? " + "w " * 49 + "w. " + "w " * 50 + "w.", "is is it is was was in in in in", "the\u00a0the x. the  the. to  ", "abcde " * 3 + "fghij klmno", " \n\n\n\n a \n\n\n\n\n\n\n\n b\n\n\n c",
    ]
    word = r"[^\W_]|_"
    rows = apply("page_figures", ocr_pages=ocr(spark, *texts)).orderBy("page_number").collect()
    for t, r in zip(texts, rows, strict=True):
        words = [w for w in re.findall(r"\w+", t.lower()) if re.fullmatch(r"[a-z]+", w)]
        n, other = len(words), [w for w in words if w not in quality.COMMON]
        assert r["words"] == words and (r["common"], r["fair"], r["long"]) == (n - len(other), sum(2 <= len(w) <= 15 for w in other), sum(len(w) > 20 for w in other))
        assert r["pairs"] == sum(len(re.findall(rf"(?:^|[^\w]){s}[ \t\n\r\f\v]+({word})", t.lower())) for s in quality.STEMS), t
        gibberish = [w for w in words if len(w) > 5 and (re.search("[bcdfghjklmnpqrstvwxyz]{4}", w) or re.search(r"(.)\1\1", w) or sum(c in "aeiou" for c in w) / len(w) < 0.2)]
        assert r["gibberish"] == len(gibberish) and r["repetitive"] == any(words.count(w) > n // 5 for w in words)
        assert r["suspicious"] == sum(len(re.findall(p, t)) for p in (r"[\x01-\x08\x0b\x0c\x0e-\x1f]", r"\|{3,}", "~{3,}", "#{5,}", "@{3,}"))
        sentences = re.split(r"[.!?]+", t)
        assert r["letters"] == sum(c.isalpha() for c in t) and r["even"] == sum(3 <= len(s.replace("\u00a0", "_").split()) <= 50 for s in sentences)
    issues = {r["page_number"]: r["issues"].split(",") for r in apply("q10_issues", ocr_pages=ocr(spark, *texts)).collect()}
    assert {k for k, v in issues.items() if "word_boundary_errors" in v} == {7} and {"rn_to_m_errors", "zero_o_confusion", "i_l_1_confusion"} <= set(issues[6])


def test_f6_to_f13_long_runs_take_linear_time(spark):
    began = time.time()
    rows = apply("page_figures", ocr_pages=ocr(spark, "z" * 24 + " " + " the" * 60_000)).select("pairs", "repetitive").collect()
    assert rows[0].asDict() == {"pairs": 30_000, "repetitive": True} and time.time() - began < 20


def test_f11_to_f13_texts_are_not_dealt_out(spark):
    for name in ("q13_quality_summary", "q14_page_report", "q15_enhance_page", "q16_processing_stats"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        dealt = plan[: plan.index(joins[0])] if joins else plan
        assert "text#" not in dealt and joins, name


def test_f3_f4_f5_f14_quick_patterns_find_the_same_places(spark):
    draw, bits = random.Random(4), ["rn", "cl", "vv", "VV", "I1", "11", "tl1e", "tI1e", "thc", "the", "O", "0", "l", "1", "a", "B", "5", " ", "  ", "\n", "\t", ".", "!", ",", ":", "|", "~", "-", "_", "#", "\u00e9", "\u2028", "\u0085"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern, to in repair.CORRECTIONS + repair.BOUNDARIES:
        holds, quick = repair.QUICK.get(pattern, ("", pattern))
        old, new = (f"regexp_replace(text, {repair.quoted(p)}, {repair.quoted(to)})" for p in (pattern, quick))
        count = lambda p: f"regexp_count(text, {repair.quoted(p)})"
        if (pattern, to) in repair.SAME:
            assert df.where(f"{old} <> text").count() == 0
            continue
        held = f"contains(text, {repair.char_by_char(holds)})" if holds else "true"
        assert df.where(f"{old} <> {new} OR {count(pattern)} <> {count(quick)} OR (NOT {held} AND {old} <> text)").count() == 0, pattern
    lines = "regexp_replace(s, r'^\\s+|\\s+$', '')"
    assert df.where(f"{repair.strip_lines('text')} <> array_join(transform(split(text, r'\\n'), s -> {lines}), chr(10))").count() == 0
    words = spark.createDataFrame([("".join(draw.choice("aeibcdy") for _ in range(draw.randint(1, 12))),) for _ in range(20_000)], "w string")
    plain = "length(w) > 5 AND (regexp_like(w, r'[bcdfghjklmnpqrstvwxyz]{4,}') OR regexp_like(w, r'aaa|eee|iii|bbb|ccc|ddd|yyy') OR (length(w) - length(regexp_replace(w, r'[aeiou]', ''))) / cast(length(w) AS double) < 0.2D)"
    assert words.where(f"({plain}) <> {quality.GIBBERISH}").count() == 0


def test_f4_spaces_in_a_row_take_linear_time(spark):
    began = time.time()
    rows = apply("p2_ocr_corrections", p1_basic_cleanup=spark.createDataFrame([("f", 1, "end" + "\u000b" * 200_000 + "x")], "file_id string, page_number int, text string")).collect()
    assert rows[0]["n_corrections"] == 0 and time.time() - began < 20
