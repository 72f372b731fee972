"""The repair steps against plain re, on damaged pages."""

import re

import pytest

from leafbound.operators import repair
from leafbound.plans.ops import apply

TEXTS = [
    "pay $  5 to a @ b. com", "' quoted '  and \" x \" ( a ) b - c -- d.Next,then", "one.\n\nfour th e fox. w ith it! a nd so", "From: j @ grnail . com\nThe cloor is rnade of woocl. rn and vv.",
    "  tab\there \x01 x\n\n\n\n y  \n z-\nab aB", "", "lnvoice # 7 INV0ICE P0 qty $ 5 ||| ~~~ ---- ____ ### # tl1e thc", "whereas the Party, section 4. it is so.Also,no", "O l 1 0x 11 I1 a0 end .\nnext", "'",
]


def rewrite(text, rules, flags=0, when=True):
    n = 0
    for pattern, to in rules if when else []:
        new = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to).replace(r"\$", "$"), text, flags=flags)
        if new != text:
            n += len(re.findall(pattern, text, flags))
        text = new
    return text, n


def clean(text):
    bare = re.sub("[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "", text)
    lines = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", bare)).split("\n")
    return "\n".join(x.strip() for x in lines), int(bare != text)


def aggressive(text):
    text, n = rewrite(text, repair.FRAGMENTS, re.I)
    parts = re.split(r"([.!?]\s+)", text)
    for i in range(0, len(parts), 2):
        if parts[i][:1].islower():
            parts[i], n = parts[i][0].upper() + parts[i][1:], n + 1
    return "".join(parts), n


def final(text):
    return "\n".join(x.strip() for x in re.sub(" {2,}", " ", text).split("\n")).strip()


def formatted(text):
    new = rewrite(text, repair.FORMATTING)[0]
    return new, int(new != text)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("f", i, i, "en", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "file_id string, page_number int, doc_id bigint, expected string, text string")


def run(name, pages, **more):
    return [tuple(r)[2:] for r in apply(name, ocr_pages=pages, **more).orderBy("page_number").collect()]


def test_steps(pages):
    cleaned = [clean(t)[0] for t in TEXTS]
    assert run("p1_basic_cleanup", pages) == [clean(t) for t in TEXTS]
    assert run("p2_ocr_corrections", pages) == [rewrite(t, repair.CORRECTIONS) for t in cleaned]
    assert run("p3_word_boundaries", pages) == [rewrite(t, repair.BOUNDARIES) for t in cleaned]
    kinds = [[rewrite(t, repair.DOMAIN[k], re.I) for k in ("email", "invoice", "contract")] for t in cleaned]
    assert run("p4_domain_corrections", pages) == [(*(x[0] for x in k), *(x[1] for x in k)) for k in kinds]
    assert run("p5_formatting", pages) == [formatted(t) for t in cleaned]
    assert run("p6_aggressive", pages) == [aggressive(t) for t in cleaned]
    assert run("p7_final_cleanup", pages) == [(final(t),) for t in cleaned]


@pytest.mark.parametrize("confidence", [0.5, 0.6])
def test_whole_chain(spark, pages, confidence):
    sure = pages.selectExpr("file_id", "page_number", f"{confidence}D AS confidence")
    want = []
    for t in TEXTS:
        kind = "email" if re.search("(?im)^from:", t) else "invoice" if re.search(r"(?i)invoice\s*#", t) else "contract" if re.search(r"(?i)\b(?:whereas|article)\b", t) else None
        text, n, steps = t, 0, []
        for name, f in [
            ("basic_cleanup", clean), ("ocr_corrections", lambda x: rewrite(x, repair.CORRECTIONS)), ("word_boundaries", lambda x: rewrite(x, repair.BOUNDARIES)), (f"{kind}_corrections", lambda x, k=kind: rewrite(x, repair.DOMAIN.get(k, []), re.I)),
            ("formatting", formatted), ("aggressive_corrections", aggressive if confidence < 0.6 else lambda x: (x, 0)),
        ]:
            text, more = f(text)
            n, steps = n + more, steps + [name] * (more > 0)
        want.append((t, final(text), n, ",".join(steps)))
    assert run("p8_process_text", pages, q8_overall_confidence=sure) == want


def test_enhanced_text(spark):
    schema = "file_id string, page_number int, doc_id bigint, expected string, text string"
    df = spark.createDataFrame([("f", 1, 1, "en", "Th1s ls a p00rly f0rmatted ||| ~~~ text rn"), ("f", 2, 2, "en", "The work is done and the day was good for us all. We like it."), ("f", 3, 3, "en", "")], schema)
    whole = {r["page_number"]: r for r in apply("p8_process_text", ocr_pages=df).collect()}
    sure = {r["page_number"]: r["confidence"] for r in apply("q8_overall_confidence", ocr_pages=df).collect()}
    got = {r["page_number"]: r for r in apply("q15_enhanced_text", ocr_pages=df).collect()}
    assert sure[1] < 0.6 <= sure[2] and [got[i]["repaired"] for i in (1, 2, 3)] == [True, False, False]
    assert got[1]["text"] == whole[1]["cleaned"] != whole[1]["original"] and got[2]["text"] == whole[2]["original"] and got[3]["text"] == ""
