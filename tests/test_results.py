"""Streams of task events, kept results, counters, files as pages."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafbound.functions import results
from leafbound.plans.ops import apply
from leafbound.plans.registry import QUERIES
from leafbound.sources import files
from leafbound.streaming import status

SF = "/root/testdata/sf0.001"


def test_stream_and_table_agree_on_status(spark, tmp_path):
    limit, schema = timedelta(hours=5), "task_id string, event_id bigint, ts timestamp, status string"
    events = apply("tasks", events=spark.read.parquet(f"{SF}/events.parquet")).selectExpr("cast(user_id AS string) AS task_id", "task_id AS event_id", "ts", "status")
    rows = [tuple(r) for r in events.collect()]
    random.Random(1).shuffle(rows)
    # The last event stands alone in the last file: event time moves on only when all others are in.
    newest = max(r[2] for r in rows)
    rows.sort(key=lambda r: r[2] == newest)
    for k in range(2):
        spark.createDataFrame(rows[:-1] if k == 0 else rows[-1:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}
    try:
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = status.stream(source, limit).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: got.update({r["task_id"]: (r["ts"], r["status"], r["n_events"]) for r in df.collect()})).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r["task_id"]: (r["ts"], r["status"], r["n_events"]) for r in status.status(events, limit).collect()}
    open_ones = {r["task_id"]: r["status"] for r in status.latest(events).collect()}
    assert {t: (got.get(t), w) for t, w in want.items() if got.get(t) != w} == {} and len(got) == len(want) and any(s != open_ones[t] for t, (_, s, _) in want.items())


def test_status_by_time(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [("a", 9, at(1), "pending"), ("a", 1, at(2), "completed"), ("b", 2, at(1), "processing"), ("c", 3, at(9), "pending"), ("c", 4, at(9), "processing"), ("d", 5, at(1), "failed")]
    df = spark.createDataFrame(rows, "task_id string, event_id bigint, ts timestamp, status string")
    got = status.status(df, timedelta(hours=4))
    assert {r["task_id"]: r["status"] for r in got.collect()} == {"a": "completed", "b": "failed", "c": "processing", "d": "failed"}
    asked = spark.createDataFrame([("a",), ("nobody",)], "task_id string")
    assert {r["task_id"]: r["status"] for r in status.lookup(got, asked).collect()} == {"a": "completed", "nobody": "failed"}


def test_results_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def compute(pages):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f[["content_key"]].assign(n=f["text"].str.len().fillna(-1).astype("int64"))

        return pages.mapInPandas(run, "content_key string, n bigint")

    rows = [("f", 1, "one"), ("f", 2, "three"), ("g", 1, "one"), (None, 2, None)]
    pages, store = spark.createDataFrame(rows, "file_id string, page_number int, text string"), str(tmp_path / "kept")
    got = lambda df, c="": {(r["file_id"], r["page_number"]): r["n"] for r in results.computed_once(df, compute, store, ["text"], c).collect()}
    want = {("f", 1): 3, ("f", 2): 5, ("g", 1): 3, (None, 2): -1}
    assert got(pages) == want and seen.value == 3
    assert got(pages) == want and seen.value == 3
    more = pages.union(spark.createDataFrame([("h", 1, "fourth")], pages.schema))
    assert got(more) == want | {("h", 1): 6} and seen.value == 4
    assert got(pages, "another configuration") == want and seen.value == 7


def test_counters_come_along(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored, counters = results.page_counters(apply("page_quality", documents=docs))
    scored.write.format("noop").mode("overwrite").save()
    assert counters.get == QUERIES["q16_processing_stats"](spark, SF).first().asDict()


def test_files_as_pages(spark, tmp_path):
    for name, data in {"a.txt": b"one  two\fthree\n\f\fl\xc3\xa4st one here", "b.txt": b"", "c.bin": b"\x00\x01"}.items():
        (tmp_path / name).write_bytes(data)
    raw = files.read_bytes(spark, str(tmp_path), "*.txt")
    import hashlib

    assert {r["file_id"][-5:]: (r["n_bytes"], r["md5"], r["sha256"]) for r in raw.collect()} == {n: (len(d), hashlib.md5(d).hexdigest(), hashlib.sha256(d).hexdigest()) for n, d in ((n, (tmp_path / n).read_bytes()) for n in ("a.txt",))}
    page = lambda df: sorted((r["file_id"][-5:], r["page_number"], r["text"], r["word_count"], r["has_tables"], r["blank"]) for r in df.collect())
    everything = [("a.txt", 1, "one  two", 2, True, False), ("a.txt", 2, "three\n", 1, False, False), ("a.txt", 3, "", 0, False, True), ("a.txt", 4, "läst one here", 3, False, False), ("b.txt", 1, "", 0, False, True)]
    empty = spark.createDataFrame([("b.txt", bytearray())], "file_id string, content binary")
    assert page(files.pages_of(raw)) + page(files.pages_of(empty)) == everything
    assert page(files.pages_of(raw, 2, 3)) == everything[1:3] and page(files.pages_of(raw, 4, 99)) == everything[3:4]
    assert {r["file_id"][-5:]: (r["text"], r["n_pages"]) for r in files.whole_texts(files.pages_of(raw)).collect()} == {"a.txt": ("one  two\fthree\n\f\fläst one here", 4)}
    plan = raw.where(F.col("n_bytes") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(length,5)" in plan
