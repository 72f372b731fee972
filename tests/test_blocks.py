"""Matching blocks against difflib; p9 over whole pages."""

import random
import time
from difflib import SequenceMatcher

import pytest

from leafbound.functions import blocks
from leafbound.plans.ops import apply
from leafbound.plans.registry import QUERIES

ALPHABETS = {"few": "ab", "prose": "eeeeeeeeeeetttttttaaaaaaaoooooo      iiinnnssrhdlu.,XYZQ019\n" * 2 + "ABCDEFGHJKLMNOPRSTUV", "many": "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "beyond 16 bits": "".join(map(chr, range(0x1F300, 0x1F300 + 200))) + "abc " * 100}


def damaged(rnd, alphabet, size):
    """A text that repeats itself, and what some edits make of it."""
    a = "".join(rnd.choices(alphabet, k=size))
    a = a[: size // 2] + a[size // 3 : size // 2 + size // 6] * rnd.randrange(3) + a[size // 2 :]
    b = list(a)
    for _ in range(rnd.choice([0, 1, 5, 40])):
        at, n = rnd.randrange(len(b) + 1), rnd.choice([1, 1, 3, 25])
        b[at : at + rnd.choice([0, n])] = rnd.choices(alphabet, k=rnd.choice([0, n]))
    return a, "".join(b)


@pytest.mark.parametrize("long", [1, 64, 10**9])
@pytest.mark.parametrize("kind", ALPHABETS)
def test_same_as_difflib(monkeypatch, kind, long):
    monkeypatch.setattr(blocks, "LONG", long)
    rnd = random.Random(7)
    for size in [0, 1, 7, 60, 199, 200, 201, 700, 1500] * 3:
        a, b = damaged(rnd, ALPHABETS[kind], size)
        for x, y in ((a, b), (b, a), (a, ""), (a, b[::-1])):
            assert blocks.ratio(x, y) == SequenceMatcher(None, x, y).ratio(), (x, y)


@pytest.mark.parametrize("kind", ["prose", "many"])
def test_long_pages_take_no_square(kind):
    rnd = random.Random(1)
    a = "".join(rnd.choices(ALPHABETS[kind], k=400_000))
    b = "".join(c for i, c in enumerate(a) if i % 9973)
    began = time.process_time()
    assert blocks.ratio(a, b) == pytest.approx(2 * len(b) / (len(a) + len(b)), abs=1e-3)
    assert time.process_time() - began < 20  # difflib takes minutes


def test_p9(spark):
    texts = ["", "The work is done.", "th e cl vv O l 1 ||| a - b , c ( d )", "one two. " * 40 + "||| ~~~ rn", " \t \x01", "Ünïcode 漢字 rn 😀 ||| x"]
    schema = "file_id string, page_number int, doc_id bigint, expected string, text string"
    df = spark.createDataFrame([(None if i == 1 else "f", i, i, "en", t) for i, t in enumerate(texts)], schema)
    whole = {r["page_number"]: r for r in apply("p8_process_text", ocr_pages=df).collect()}
    got = {r["page_number"]: r for r in apply("p9_similarity_ratio", ocr_pages=df).collect()}
    assert {i: r["similarity"] for i, r in got.items()} == {i: round(SequenceMatcher(None, r["original"], r["cleaned"]).ratio(), 3) for i, r in whole.items()} and len(got) == 6
    assert got[1]["file_id"] is None and got[2]["similarity"] < 1


def test_texts_are_not_dealt_out(spark):
    plan = QUERIES["p9_similarity_ratio"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    join = plan.toString().index("Join")
    assert plan.schema().fieldNames()[2] == "similarity" and "MapInArrow" in plan.toString()[join:] and "Window" in plan.toString()[:join]
