"""Nothing of a page, range, task or text is left out; empty and damaged pages are fixtures here."""

import pytest

from leafbound.plans.registry import apply

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def test_ocr_pages_hold_whole_texts(spark):
    long = "plain words here. " * 500 + "the last rn word"
    docs = documents(spark, [(4, "fourth"), (13, long), (22, None), (31, "")])
    got = {r["doc_id"]: r["text"] for r in apply("ocr_pages", documents=docs).collect()}
    assert got[4].endswith("fourth") and got[13] == long and got[31] == ""
    words = {r["page_number"]: r["n_words"] for r in apply("q12_metrics", documents=docs).collect()}
    assert words[2] == 1504
    issues = {r["page_number"]: r["issues"] for r in apply("q10_issues", documents=docs).collect()}
    assert "rn_to_m_errors" in issues[2] and issues[4] == "no_text_detected"
    ends = {r["page_number"]: r["text"][-15:] for r in apply("p2_ocr_corrections", documents=docs).collect()}
    assert ends[2] == " the last m word"[-15:]


def test_empty_and_damaged_pages(spark):
    rows = [("f", 1, 1, "en", ""), ("f", 2, 2, "en", "~~~ @@@ ||| xxxxxxxxxxxxxxxxxxxxxxxxxxxxx"), ("f", 3, 3, "en", "The work is done and the day was good for us all.")]
    df = spark.createDataFrame(rows, "file_id string, page_number int, doc_id bigint, expected string, text string")
    got = [r["confidence"] for r in apply("q8_overall_confidence", ocr_pages=df).orderBy("page_number").collect()]
    assert got[0] == 0 and got[1] < 0.6 < got[2]


def test_pages_seeded_hold_whole_texts(spark):
    long = "word " * 200 + "end"
    docs = documents(spark, [(12, long), (17, long), (23, long), (10, None)])
    got = [r for r in apply("pages_seeded", documents=docs).orderBy("doc_id").collect()]
    assert [r["text"].endswith(long) for r in got] == [False, True, True, True] and got[0]["text"] == ""
    assert [r["word_count"] for r in apply("s7_text_page", documents=docs).orderBy("page_number").collect()][2:] == [205, 201]


def test_short_and_empty_pages(spark):
    rows = [("f", i, i, "en", t, len(t.split()), False, False, None, 0, 612.0, 792.0) for i, t in enumerate(["", "few words", "word " * 60], 1)]
    schema = "file_id string, page_number int, doc_id bigint, lang string, text string, word_count int, has_images boolean, has_tables boolean, ocr_confidence double, n_issues int, width double, height double"
    df = spark.createDataFrame(rows, schema)
    assert [r["mostly_empty"] for r in apply("s7_text_page", pages_seeded=df).orderBy("page_number").collect()] == [True, True, False]
    # page 2 starts by white space; page 3 has 60 words, and 58 more are no change of density
    assert [r[0] for r in apply("b4_segment_pages", pages_seeded=df).orderBy("start_page").select("start_page").collect()] == [1, 2]


def test_pages_are_numbered_over_blocks(spark):
    ids = [-700, -1, 0, 255, 256, 257, 511, 512, 5000, 2**40, *range(1000, 1900)]
    docs = documents(spark, [(i, str(i)) for i in ids]).unionAll(spark.createDataFrame([(3, "x", "en", None, 1), (900, "y", "en", None, 1)], DOCS))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = apply("pages_doc", documents=docs)
        got = {(r["file_id"], r["doc_id"]): r["page_number"] for r in pages.collect()}
        spread = len({r["p"] for r in pages.where("file_id = 's'").selectExpr("spark_partition_id() AS p", "page_number").collect()})
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {("s", i): n for n, i in enumerate(sorted(ids), 1)} | {(None, 3): 1, (None, 900): 2}
    assert spread > 1  # one file is not one task


def test_merge_keeps_every_range(spark):
    rows = [("f", 1, 1, 0.9, "a"), ("f", 2, 4, 0.8, "b"), ("f", 7, 8, 0.7, "c"), ("f", 9, 12, 0.6, "d"), ("g", 5, 5, 0.5, "e")]
    df = spark.createDataFrame(rows, "file_id string, start_page int, end_page int, confidence double, document_type string")
    got = [tuple(r) for r in apply("b18_merge_close", b4_segment_pages=df).orderBy("file_id", "start_page").collect()]
    assert got == [("f", 1, 4, 0.9, 2), ("f", 7, 12, 0.7, 2), ("g", 5, 5, 0.5, 1)]


def test_feedback_holds_every_verdict(spark):
    docs = documents(spark, [(i, "x") for i in range(14)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14)], "doc_id bigint, quality int, toxic int")
    got = {r["page_number"]: r["is_boundary"] for r in apply("feedback", documents=docs, labels=labels).collect()}
    assert got == {i + 1: i % 2 == 1 for i in range(14)}


def test_every_waiting_task_is_queued(spark):
    rows = [(i, i % 11, f"2024-01-01 {i * 7 % 24:02d}:{i % 4}0:00", [None, "high", "low", "normal", "urgent"][i % 5], "pending" if i % 3 else "failed") for i in range(200)]
    tasks = spark.createDataFrame(rows, "task_id bigint, user_id bigint, ts string, priority string, status string").selectExpr("task_id", "user_id", "cast(ts AS timestamp) AS ts", "priority", "status")
    waiting = [r for r in rows if r[4] == "pending"]
    meant = sorted(waiting, key=lambda r: ({"high": 1, "normal": 2}.get(r[3], 3), r[2], r[0]))
    spelled = sorted(waiting, key=lambda r: (r[3] or "", r[2], r[0]))
    got = {r["task_id"]: (r["position"], r["spelled_position"]) for r in apply("task_queue_order", tasks=tasks).collect()}
    assert got == {r[0]: (meant.index(r) + 1, spelled.index(r) + 1) for r in waiting}


def test_validators(spark):
    """What each pattern counts, by hand."""
    rows = [("f", 1, 1, "en", "Call (555) 123-4567 or +1 202 555 0100; see http://www.example.org/a and https://x.co. Up 12 % and 3.5%."), ("f", 2, 2, "en", "Jan 5, 2024 and xJan 6, 2024; 1/2/24, 2024-03-05, $ 12.50, € 3"), ("f", 3, 3, "en", "")]
    df = spark.createDataFrame(rows, "file_id string, page_number int, doc_id bigint, expected string, text string")
    got = [r.asDict() for r in apply("q17_validators", ocr_pages=df).orderBy("page_number").collect()]
    assert [got[0][c] for c in ("phones", "urls", "percentages")] == [2, 2, 2]
    assert [got[1][c] for c in ("dates", "amounts")] == [3, 2] and sum(v for k, v in got[2].items() if k not in ("file_id", "page_number")) == 0
