"""Blocks, bins and late numbering: the same rows as plain windows and joins, and plans that don't put a file into one task."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafbound.functions import intervals, windows
from leafbound.operators import fusion, sinks
from leafbound.plans.ops import apply
from leafbound.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def gappy(spark):
    rng = random.Random(5)
    rows = [(f, p, rng.choice([None, rng.randrange(9)])) for f in ("a", "b", None) for p in sorted(rng.sample(range(-5, 400), 90))] + [("one", 7, 1)]
    return spark.createDataFrame(rows, "file_id string, page_number int, v int").repartition(5)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 10_000])
@pytest.mark.parametrize("back,ahead", [(1, 0), (0, 1), (2, 2), (3, 1)])
def test_beside(gappy, block, back, ahead):
    w = Window.partitionBy("file_id").orderBy("page_number")
    row = F.struct("page_number", "v")
    want = gappy.select("*", *[F.lag(row, k).over(w).alias(f"before{k}") for k in range(1, back + 1)], *[F.lead(row, k).over(w).alias(f"after{k}") for k in range(1, ahead + 1)])
    got = windows.beside(gappy, ["page_number", "v"], back, ahead, block=block)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("block", [1, 3, 64, 10_000])
@pytest.mark.parametrize("how,own", [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_running(gappy, block, how, own):
    w = Window.partitionBy("file_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    want = gappy.withColumn("r", getattr(F, how)("v").over(w))
    got = windows.running(gappy, "r", F.col("v"), how, own, block=block)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_ranges_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 4)
    rng, rows, want = random.Random(6), [], []
    for f in ("x", None):
        starts = [1, *sorted(rng.sample(range(2, 60), 13))]
        rows += [(f, p, p in starts, p == 60) for p in range(1, 61)]
        want += [(f, a, b - 1) for a, b in zip(starts, [*starts[1:], 61], strict=True)]
    df = spark.createDataFrame(rows, "file_id string, page_number int, s boolean, l boolean").repartition(3)
    got = [tuple(r) for r in windows.ranges(df, "s", "l").select("file_id", "start_page", "end_page").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("size", [1, 5, 256])
def test_interval_joins(spark, size):
    rng = random.Random(size)
    rows = lambda n: [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 1, 30, -1])) for s in (rng.randrange(1, 90) for _ in range(n))]
    left, right, points = rows(60), rows(60), [(rng.choice(["a", "b", None]), rng.randrange(1, 120)) for _ in range(150)]
    a, b = spark.createDataFrame(left, "file_id string, s int, e int"), spark.createDataFrame(right, "file_id string, start_page int, end_page int")
    p = spark.createDataFrame(points, "file_id string, page_number int")
    got = intervals.overlap(a, b, ("s", "e"), ("start_page", "end_page"), size=size).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((f, s, e, x, y)) for f, s, e in left for g, x, y in right if f == g and s <= e and x <= y and s <= y and x <= e)
    got = intervals.cover(p, b, size=size).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((f, n, x, y)) for f, n in points for g, x, y in right if f == g and x <= n <= y)


def test_interval_join_of_a_long_file(spark):
    """200,000 pages of one file and 20,000 ranges: no task has more than a bin's pairs, and the plan joins on bins."""
    pages = spark.range(200_000).select(F.lit("f").alias("file_id"), (F.col("id") + 1).cast("int").alias("page_number"))
    parts = spark.range(20_000).select(F.lit("f").alias("file_id"), (10 * F.col("id") + 1).cast("int").alias("start_page"), (10 * F.col("id") + 10).cast("int").alias("end_page"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = intervals.cover(pages, parts)
        assert joined.groupBy("start_page").count().where("count <> 10").count() == 0 and joined.count() == 200_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin.*_bin|ShuffledHashJoin.*_bin", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_parts_are_written_once(spark, tmp_path):
    pages = spark.createDataFrame([("f", i, f"page {i}") for i in range(1, 30)], "file_id string, page_number int, text string")
    parts = spark.createDataFrame([("f", 1, 9), ("f", 10, 29)], "file_id string, start_page int, end_page int")
    path = str(tmp_path / "parts")
    got = lambda: sorted((r["start_page"], r["page_number"]) for r in sinks.read_parts(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        sinks.read_parts(spark, path)
    # A run in which a task's attempt fails after some rows were written: nothing of it is seen.
    broken = pages.repartition(3).withColumn("text", F.expr("CASE WHEN page_number = 20 THEN raise_error('disk') ELSE text END"))
    with pytest.raises(Exception, match="disk"):
        sinks.write_parts(broken, parts, path)
    with pytest.raises(FileNotFoundError):
        sinks.read_parts(spark, path)
    sinks.write_parts(pages, parts, path)
    want = [(1 if i < 10 else 10, i) for i in range(1, 30)]
    assert got() == want
    with pytest.raises(Exception, match="disk"):
        sinks.write_parts(broken, parts, path)
    assert got() == want
    second = sinks.write_parts(pages.where("page_number < 12"), parts, path)
    version, listed = sinks.manifest(spark, path)
    assert got() == want[:11] and version == second and sorted((r["start_page"], r["first_page"], r["last_page"], r["n_pages"]) for r in listed.collect()) == [(1, 1, 9, 9), (10, 10, 11, 2)]


# ---- plans


def plan_of(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("name", ["t1_email_header", "q1_char_confidence", "q8_overall_confidence", "b4_segment_pages", "b9_plugin_segment", "w22_visual_continuity"])
def test_texts_stay_where_they_are_read(spark, name):
    """What goes through a shuffle has no text among its columns."""
    shuffled = []
    tree = spark_nodes(QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan())
    for node in tree:
        if node.nodeName() in ("Window", "SortMergeJoin", "Sort", "BroadcastHashJoin", "ShuffledHashJoin"):
            for child in seq(node.children()):
                shuffled += [a.name() for a in seq(child.output())]
    assert shuffled and not {"text", "h500", "l1000", "h1000", "l500", "lines", "edge", "words", "sentences"} & set(shuffled)


def seq(s):
    return [s.apply(i) for i in range(s.size())]


def spark_nodes(node):
    yield node
    for child in seq(node.children()):
        yield from spark_nodes(child)


@pytest.mark.parametrize("name", ["b4_segment_pages", "b9_plugin_segment", "b11_hybrid_fuse", "b18_merge_close", "w1_layout_change", "w7_near_boundary", "w22_visual_continuity", "t13_text_snippets", "o4_ocr_page_limit", "o9_processing_order"])
def test_no_window_over_a_whole_file(spark, name):
    found = re.findall(r"windowspecdefinition\((.*?)(?:, specifiedwindowframe|\))", plan_of(spark, name)) or [""]
    # Only the counts of pages before each block of ids (a row a block) go by file alone.
    for spec in re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan_of(spark, name)):
        keys = [k for k in spec[0].split(", ") if k]
        assert len(keys) > 1, spec
        assert "_b" in spec[0] or "_w" in spec[0] or "_b" in spec[1], spec
    assert found


@pytest.mark.parametrize("name,most", [("t1_email_header", 2), ("q8_overall_confidence", 2), ("q10_issues", 2), ("p4_domain_corrections", 2), ("p8_process_text", 2), ("b4_segment_pages", 2), ("b9_plugin_segment", 4), ("b10_visual_confidence", 2), ("b11_hybrid_fuse", 4), ("b16_llm_merge", 4), ("b17_method_merge", 8)])
def test_scans(spark, name, most):
    """One scan of the texts, one of ids for the numbers, for each side that is joined."""
    assert plan_of(spark, name).count("Scan parquet") <= most


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_methods_merge_whatever_is_reused(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = QUERIES["b17_method_merge"](spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(rows) == len({(r["file_id"], r["start_page"]) for r in rows}) == 1000


# ---- null files, repeated rows, hot files


def test_null_file_is_a_file(spark):
    rows = [(i, f"INVOICE #{i} " + "word " * (60 if i % 2 else 400), "en", None if i % 2 else "s", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    for name in ("b2_rule_confidence", "b4_segment_pages", "b9_plugin_segment", "b11_hybrid_fuse", "b13_range_type", "b16_llm_merge", "b18_merge_close", "b20_split_naming", "s10_rag_export", "s11_delete", "o9_processing_order", "b21_validate_update", "q13_quality_summary"):
        inputs = {"documents": docs} | ({"labels": labels} if name == "b21_validate_update" else {})
        assert {r["file_id"] for r in apply(name, **inputs).collect()} == {None, "s"}, name


def test_repeated_ids_are_numbered_by_content(spark):
    rows = [(7, f"text {i % 4}", "en", "s", 0) for i in range(12)] + [(None, "no id", "en", "s", 0), (8, "last", "en", "s", 0)]
    one, two = ({r["page_number"]: r["text"] for r in apply("pages_doc", documents=spark.createDataFrame(rows, DOCS).repartition(n)).collect()} for n in (1, 7))
    assert one == two and set(one) == set(range(1, 15)) and one[1] == "no id" and one[14] == "last"


def test_hot_file(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 16)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("INVOICE #"), F.col("id").cast("string"))).otherwise(F.lit("word " * 60)).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 == 0, F.lit("small")).otherwise(F.lit("hot")).alias("source"), F.lit(1).alias("n_chars"))
    blocks = sorted(map(tuple, apply("b4_segment_pages", documents=docs).collect()))
    monkeypatch.setattr(windows, "BLOCK", 10**9)
    assert blocks == sorted(map(tuple, apply("b4_segment_pages", documents=docs).collect())) and len(blocks) > 400


def test_post_processors_in_order(spark):
    df = spark.createDataFrame([("f", 1, 1, 0.9, "a"), ("f", 9, 9, 0.8, "b"), ("f", 14, 20, 0.7, "c")], "file_id string, start_page int, end_page int, confidence double, document_type string")
    got = fusion.post_process(df, (fusion.merge_close, 8), lambda r: r.where("confidence > 0.8"), lambda r: r.withColumn("end_page", F.col("end_page") + 1))
    assert [tuple(r) for r in got.select("start_page", "end_page").collect()] == [(1, 21)]
    with pytest.raises(TypeError):
        fusion.post_process(df, lambda r: r.drop("end_page"))
