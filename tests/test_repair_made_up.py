"""The repair steps against plain re, on many made-up pages: a rule that is passed over would have changed nothing."""

import random
import re

from test_repair import aggressive, clean, final, formatted, rewrite

from leafbound.operators import repair
from leafbound.plans.ops import apply

PIECES = [*"rnclvVOI1t0lehaZ9", *" \t\n\r.!?,;:\"'()-|~_#$@", " rn ", " cl ", "vv", "VV", "tl1e", "tI1e", "thc", "the", "11", "I1", "--", "  ", "\n\n\n", "\x01", "\x85", " ", "é", "from:", "\nFrom: ", "INVOICE #", "Article", "whereas", "th e", "o f"]


def test_made_up_pages(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(PIECES, k=rnd.choice([1, 2, 4, 8, 16, 60]))) for _ in range(1500)]
    df = spark.createDataFrame([("f", i, i, "en", t) for i, t in enumerate(texts)], "file_id string, page_number int, doc_id bigint, expected string, text string").repartition(4).cache()
    one = {r["page_number"]: r for r in apply("p1_basic_cleanup", ocr_pages=df).collect()}
    cleaned = [one[i]["text"] for i in range(len(texts))]
    # plain re takes more for white space; where it agrees on the cleaned text, all else must
    same = [i for i, t in enumerate(texts) if clean(t)[0] == cleaned[i] and not re.search("[\x85 \xa0\x1c-\x1f]", t)]
    assert len(same) > 900 and all(one[i]["n_corrections"] == clean(texts[i])[1] for i in same)
    for name, plain in (("p2_ocr_corrections", lambda t: rewrite(t, repair.CORRECTIONS)), ("p5_formatting", formatted), ("p7_final_cleanup", lambda t: (final(t),)), ("p6_aggressive", aggressive)):
        got = {r["page_number"]: tuple(r)[2:] for r in apply(name, ocr_pages=df).collect()}
        for i in same:
            assert got[i] == plain(cleaned[i]), (name, texts[i])


def test_kinds(spark):
    texts = ["FROM: a", "x\nfrom: a", "x from: a", "Invoice \t#", "invoice 4", "my ARTICLE", "articles", "whereas", "ıNVOICE #"]
    df = spark.createDataFrame([("f", i, i, "en", t) for i, t in enumerate(texts)], "file_id string, page_number int, doc_id bigint, expected string, text string")
    kinds = [r["kind"] for r in apply("repaired", ocr_pages=df).orderBy("page_number").collect()]
    assert kinds == ["email", "email", None, "invoice", None, "contract", None, "contract", None]
