"""Every declared operator against DuckDB on the smallest tables; golden pages; invariants."""

import glob
import math
import os

import duckdb
import pytest

from leafbound.plans.ops import OPS, apply
from leafbound.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


QUICK = ["s5_ground_truth", "t1_email_header", "t3_page_number_reset", "t5_document_type", "t18_llm_json_parse", "w4_visual_change", "w21_layout_similarity", "w23_vlm_similarity", "g6_visual_signature", "b4_segment_pages", "b5_refine_feedback", "b7_plugin_confidence", "b8_type_vote", "b9_plugin_segment", "b10_visual_confidence", "b11_hybrid_fuse", "b13_range_type", "b15_ambiguous_cases", "b16_llm_merge", "b17_method_merge", "b18_merge_close", "b19_enhanced_post", "s10_rag_export", "t14_prompt_render", "o9_processing_order", "a7_overlap_scores", "a1_signal_histogram", "q17_validators", "q1_char_confidence", "q2_word_confidence", "q10_issues", "p1_basic_cleanup", "p3_word_boundaries", "p5_formatting", "p7_final_cleanup", "o7_critical_pages", "a6_eval_position", "a7_eval_overlap"]
# all of them with LEAFBOUND_ALL=1
NAMES = sorted(ORACLES) if os.environ.get("LEAFBOUND_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == cols
    order = [theirs.columns.index(c) for c in cols]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in order)) for r in theirs.fetchall())


def pages(spark, rows):
    schema = "file_id string, page_number int, text string, word_count int"
    df = spark.createDataFrame([("f", i, t, w) for i, (t, w) in enumerate(rows, 1)], schema)
    return df.selectExpr("*", "cast(page_number as bigint) AS doc_id", "612D AS width", "792D AS height", "'en' AS lang", "false AS has_images", "false AS has_tables", "cast(null as double) AS ocr_confidence", "0 AS n_issues")


def starts(spark, rows):
    return [tuple(r) for r in apply("b4_segment_pages", pages_seeded=pages(spark, rows)).orderBy("start_page").select("start_page", "end_page", "confidence").collect()]


def test_fusion_by_hand(spark):
    got = starts(spark, [("word " * 60, 60), ("INVOICE #12 " + "word " * 60, 400), ("word " * 60, 400)])
    # page 2: heading .85, layout .6, type change .8, so two strong signals; page 3: type change alone
    want2 = (0.85 * 0.85 + 0.6 * 0.6 + 0.8 * 0.8) / (0.85 + 0.6 + 0.8) * 1.2
    assert [g[:2] for g in got] == [(1, 1), (2, 2), (3, 3)]
    assert got[1][2] == pytest.approx(want2) and got[2][2] == pytest.approx(0.8)


def test_white_space_threshold(spark):
    assert [g[0] for g in starts(spark, [("a " * 100, 34), ("a " * 100, 33)])] == [1, 2]
    assert [g[0] for g in starts(spark, [("a " * 100, 34), ("a " * 100, 34)])] == [1]


def test_single_page_and_none(spark):
    assert starts(spark, [("x", 1)]) == [(1, 1, 1.0)]
    assert starts(spark, []) == []


def test_ranges_are_contiguous(spark):
    rows = QUERIES["b11_hybrid_fuse"](spark, SF).orderBy("file_id", "start_page").collect()
    last = {}
    for r in rows:
        assert r["start_page"] == last.get(r["file_id"], 0) + 1 and r["end_page"] >= r["start_page"] and 0 <= r["confidence"] <= 1
        last[r["file_id"]] = r["end_page"]


def test_repair(spark):
    text = "The cloor is rnade of woocl. rn and vv."
    df = spark.createDataFrame([("f", 1, 1, "en", text)], "file_id string, page_number int, doc_id bigint, expected string, text string")
    got = apply("p2_ocr_corrections", ocr_pages=df).first()
    assert got["text"] == "The cloor is rnade of woocl. m and w." and got["n_corrections"] > 0
    torn = spark.createDataFrame([("f", 1, 1, "en", "th e quick fox. w ith it")], "file_id string, page_number int, doc_id bigint, expected string, text string")
    assert apply("p6_aggressive", ocr_pages=torn).first()["text"] == "The quick fox. With it"


def test_inputs_can_be_replaced(spark):
    with pytest.raises(KeyError):
        apply("t1_email_header", benchmark=spark.range(1))
    assert all(o.about for o in OPS.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_task_stream(spark, tmp_path):
    from leafbound.streaming import tasks

    rows = [("a", "2024-01-01 00:00:00", "pending", "low"), ("a", "2024-01-01 00:05:00", "completed", "low"), ("b", "2024-01-01 00:01:00", "pending", "high"), ("c", "2024-01-01 00:00:30", "pending", "normal")]
    batch = spark.createDataFrame(rows, "task_id string, ts string, status string, priority string").selectExpr("task_id", "cast(ts as timestamp) ts", "status", "priority")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = tasks.status(stream).writeStream.outputMode("complete").format("memory").queryName("statuses").start()
    query.processAllAvailable()
    query.stop()
    assert {r["task_id"]: r["status"] for r in spark.table("statuses").collect()} == {"a": "completed", "b": "pending", "c": "pending"}
    assert [r["task_id"] for r in tasks.waiting(spark.table("statuses")).collect()] == ["b", "c"]
