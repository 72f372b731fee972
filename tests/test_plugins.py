"""Detectors and models that callers bring."""

import time

import pytest
from pyspark.sql import functions as F

from leafbound.operators import detectors, models
from leafbound.operators.fusion import merge_verdicts
from leafbound.plans.ops import apply
from leafbound.plans.registry import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"STARTS HERE {i}" + " word" * 60 if i % 5 == 3 else "plain " + "word " * 60, "en", None if i % 2 else "s", 0) for i in range(40)], DOCS)


@pytest.fixture
def plugins():
    yield detectors
    for name in list(detectors.REGISTERED):
        detectors.unregister(name)


def marks(pages):
    return pages.where("text LIKE '%STARTS HERE%' AND page_number > 1").select("file_id", "page_number", F.lit("stamp").alias("signal"), F.lit(0.9).alias("confidence"))


def starts(docs):
    return {(r["file_id"], r["start_page"]) for r in apply("b9_plugin_segment", documents=docs).collect()}


def test_detector_changes_ranges(docs, plugins):
    before = starts(docs)
    plugins.register("stamps", marks, {"stamp": 3.0})
    want = {(r["file_id"], r["page_number"]) for r in marks(apply("pages_seeded", documents=docs)).collect()}
    found = {(r["file_id"], r["page_number"]) for r in apply("b6_plugin_group", documents=docs).where("plugin = 'stamps'").collect()}
    assert found == want != set() and {f for f, _ in want} == {None, "s"}
    after = starts(docs)
    assert want <= after != before and plugins.FAILURES == {}
    got = {(r["file_id"], r["page_number"]): r for r in apply("b7_plugin_confidence", documents=docs).collect()}
    plugins.unregister("stamps")
    was = {(r["file_id"], r["page_number"]): r for r in apply("b7_plugin_confidence", documents=docs).collect()}
    assert all(got[k]["n_signals"] == (was[k]["n_signals"] if k in was else 0) + 1 for k in want) and starts(docs) == before


def test_failing_detectors_are_left_out_and_reported(spark, docs, plugins):
    broken = F.udf(lambda t: 1 / 0, "double")
    plugins.register("raises", lambda pages: 1 / 0)
    plugins.register("wrong", lambda pages: pages.select("file_id", "page_number"))
    plugins.register("mistyped", lambda pages: pages.selectExpr("file_id", "page_number", "1 AS signal", "0.5D AS confidence"))
    plugins.register("late", lambda pages: pages.select("file_id", "page_number", F.lit("x").alias("signal"), broken("text").alias("confidence")))
    plugins.register("stamps", marks, {"stamp": 3.0})
    plugins.register("odd", lambda pages: pages.selectExpr("file_id", "page_number", "CASE WHEN page_number = 2 THEN 'y' END AS signal", "CASE WHEN page_number = 2 THEN double('NaN') ELSE 7D END AS confidence"))
    groups = {r["plugin"] for r in apply("b6_plugin_group", documents=docs).collect()}
    assert "stamps" in groups and not groups & {"raises", "wrong", "mistyped", "late", "odd"}
    assert set(plugins.FAILURES) == {"raises", "wrong", "mistyped", "late"} and "ZeroDivisionError" in plugins.FAILURES["raises"] and "signal, confidence" in plugins.FAILURES["wrong"]
    with pytest.raises(ValueError):
        plugins.register("heavy", marks, {"stamp": -1})


# ---- models


def slow(prompt):
    if "sleep" in prompt:
        time.sleep(60)
    if "fail" in prompt:
        raise RuntimeError("refused")
    return '{"is_boundary": true, "confidence": 0.9}' if "yes" in prompt else "No."


def test_calls_in_parallel_with_errors_and_timeouts():
    began = time.time()
    got = models.call_all(slow, ["yes", "sleep", "fail", "no", "sleep too", "yes"] * 2, 2, 1.0)
    assert [e is None for _, e in got] == [True, False, False, True, False, True] * 2 and got[2][1] == "RuntimeError: refused" and got[1][1] == "no reply in 1.0 s"
    assert got[5][0].startswith("{") and time.time() - began < 20 and models.call_all(slow, [], 4, 1) == []


def test_replies_are_stored(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise ValueError("bad prompt")
        return prompt.upper()

    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "id int, prompt string").repartition(3)
    store = str(tmp_path / "store")
    first = {r["id"]: (r["reply"], r["error"]) for r in models.ask(prompts, model, store).collect()}
    assert first == {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, "ValueError: bad prompt"), 5: (None, None)}
    assert sorted(open(log).read().split()) == ["a", "b", "bad"]
    more = prompts.union(spark.createDataFrame([(6, "c")], prompts.schema))
    again = {r["id"]: (r["reply"], r["error"]) for r in models.ask(more, model, store).collect()}
    assert again == first | {6: ("C", None)} and sorted(open(log).read().split()) == ["a", "b", "bad", "bad", "c"]


def test_verdicts(spark):
    said = ['x {"is_boundary": true, "confidence": 0.8, "document_type": "RFI"} y', '{"is_boundary": false}', "Yes, confidence 0.7", "boundary: true", "No.", "{broken", '{"is_boundary": true, "confidence": "high", "document_type": "memo"}', '{"is_boundary": true, "confidence": 7}', None]
    got = models.verdicts(spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id int, reply string")).orderBy("id").collect()
    assert [(r["yes"], r["confidence"], r["document_type"]) for r in got] == [(True, 0.8, "report"), (False, 0.5, "other"), (True, 0.7, "other"), (True, 0.5, "other"), (False, 0.5, "other"), (False, 0.5, "other"), (True, 0.5, "other"), (True, 1.0, "other")]


def test_model_merges_into_ranges(spark, docs):
    pages = apply("rule_pages", documents=docs)
    asked = pages.where("page_number = 7").select("file_id", "page_number")
    texts = apply("page_cuts", documents=docs).selectExpr("file_id", "page_number", "head AS text")
    store = spark.conf.get("spark.checkpoint.dir") + "/replies-test"
    said = models.judge(asked, texts, "{text}|{page_number}", lambda p: '{"is_boundary": true, "confidence": 0.95, "document_type": "invoice"}' if p.endswith("|7") else "No.", store)
    got = {(r["file_id"], r["start_page"]): (r["confidence"], r["document_type"]) for r in merge_verdicts(pages, said).collect()}
    was = {(r["file_id"], r["page_number"]): r["confidence"] if r["starts"] else 0.0 for r in pages.collect()}
    assert all(got[f, 7] == (max(0.95, was[f, 7]), "invoice") for f in (None, "s"))


def test_model_query(spark):
    rows = QUERIES["b16_model_merge"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["end_page"] - r["start_page"] + 1 for r in rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_model_query_reads_texts_once(spark):
    """What the rules say and the prompts are stored before ranges are made: the result reads no text again."""
    assert not [f for f in QUERIES["b16_model_merge"](spark, "/root/testdata/sf0.001").inputFiles() if "documents" in f]


def test_prompts_are_computed_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prompt(i):
        made.add(1)
        return f"p{i % 3}"

    got = models.ask(spark.range(30).repartition(3).select("id", prompt("id").alias("prompt")), str.upper, str(tmp_path / "store")).collect()
    assert {r["id"]: r["reply"] for r in got} == {i: f"P{i % 3}" for i in range(30)} and made.value == 30
