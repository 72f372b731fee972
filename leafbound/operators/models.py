"""A model in the loop: prompts out, replies in, verdicts for merging.

The model is a function from a prompt to a reply that callers bring; it runs in tasks. Replies are stored by the hash of
their prompt, so equal prompts are asked once and a second run asks nothing again; calls that fail or take too long give a row
with the error, and are asked again next time.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafbound.functions.shared import stored
from leafbound.operators.text import LLM_TYPES, render

STORED = "hash string, reply string, error string"


def call_all(model: Callable[[str], str], prompts: list[str], parallel: int, timeout: float) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt, `parallel` at a time. A call that takes longer than `timeout` seconds is given up; its thread doesn't keep the worker alive."""
    out: list[tuple[str | None, str | None] | None] = [None] * len(prompts)
    todo: queue.SimpleQueue[int] = queue.SimpleQueue()
    for i in range(len(prompts)):
        todo.put(i)
    began: dict[int, float] = {}
    lock, done = threading.Condition(), set()

    def work() -> None:
        while True:
            try:
                i = todo.get_nowait()
            except queue.Empty:
                return
            with lock:
                began[i] = time.monotonic()
            try:
                answer = (str(model(prompts[i])), None)
            except Exception as e:  # whatever the caller's function raises
                answer = (None, f"{type(e).__name__}: {e}")
            with lock:
                if i in done:  # given up meanwhile: another thread has this one's place
                    return
                out[i] = answer
                done.add(i)
                lock.notify()

    def start() -> None:
        threading.Thread(target=work, daemon=True).start()

    for _ in range(min(parallel, len(prompts))):
        start()
    with lock:
        while len(done) < len(prompts):
            lock.wait(0.05)
            late = [i for i, t in began.items() if i not in done and time.monotonic() - t > timeout]
            for i in late:
                out[i] = (None, f"no reply in {timeout} s")
                done.add(i)
                start()
    return out  # type: ignore[return-value]


def _known(store: str, like: DataFrame) -> DataFrame:
    spark = like.sparkSession
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException:  # nothing was stored yet
        return spark.createDataFrame([], STORED)


def ask(prompts: DataFrame, model: Callable[[str], str], store: str, parallel: int = 4, timeout: float = 30.0, batch: int = 64) -> DataFrame:
    """prompts (with a column `prompt`) with `reply` and `error`. store: a folder that all executors share; it is added to.

    Null prompts aren't asked and have neither. `parallel` bounds the calls of one task at a time. Prompts are computed once, and kept in a
    folder beside the store, as they are asked and then joined with their replies.
    """
    keyed = stored(prompts.withColumn("_hash", F.sha2("prompt", 256)), f"{store.rstrip('/')}-prompts", "asked")
    answered = _known(store, prompts).where("reply IS NOT NULL").select(F.col("hash").alias("_hash")).distinct()
    todo = keyed.where("prompt IS NOT NULL").groupBy("_hash").agg(F.first("prompt").alias("prompt")).join(answered, "_hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                some = f.iloc[at : at + batch]
                said = call_all(model, some["prompt"].tolist(), parallel, timeout)
                yield pd.DataFrame({"hash": some["_hash"].to_numpy(object), "reply": pd.Series([r for r, _ in said], dtype=object), "error": pd.Series([e for _, e in said], dtype=object)})

    todo.mapInPandas(run, STORED).write.mode("append").parquet(store)
    best = Window.partitionBy("hash").orderBy(F.col("reply").isNull(), "reply", "error")
    replies = _known(store, prompts).withColumn("_n", F.row_number().over(best)).where("_n = 1").select(F.col("hash").alias("_hash"), "reply", "error")
    return keyed.join(replies, "_hash", "left").drop("_hash")


def verdicts(replies: DataFrame) -> DataFrame:
    """Replies (with a column `reply`) with yes, confidence and document_type: by the JSON in them, else by words and numbers; without a reply there is no verdict."""
    said = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    j = replies.where("reply IS NOT NULL").withColumn("_j", said)
    get = lambda k: F.get_json_object("_j", f"$.{k}")
    readable = F.coalesce(F.expr("try_parse_json(_j)").isNotNull(), F.lit(False)) & (F.col("_j") != "")
    lower, number = F.lower("reply"), F.regexp_extract("reply", r"confidence[^0-9]*([0-9]+\.[0-9]+)", 1)
    kinds = F.create_map(*[F.lit(x) for kv in LLM_TYPES.items() for x in kv])
    sure = F.coalesce(F.when(readable, get("confidence").try_cast("double")).otherwise(F.nullif(number, F.lit("")).try_cast("double")), F.lit(0.5))
    return j.withColumns({
        "yes": F.when(readable, F.coalesce(get("is_boundary") == "true", F.lit(False))).otherwise(F.contains(lower, F.lit("yes")) | F.contains(lower, F.lit("boundary: true"))),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)),
        "document_type": F.coalesce(F.try_element_at(kinds, F.lower(F.when(readable, get("document_type")))), F.lit("other")),
    }).drop("_j")


def judge(pages: DataFrame, texts: DataFrame, template: str, model: Callable[[str], str], store: str, **how) -> DataFrame:
    """A model's verdicts on pages (file_id, page_number): their texts put into a template, asked, read. Failed calls have no row."""
    key = ["file_id", "page_number"]
    left = pages.select(F.col("file_id").alias("_file"), F.col("page_number").alias("_page"))
    shown = texts.join(left, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("page_number") == F.col("_page"))).drop("_file", "_page")
    return verdicts(ask(render(shown, {"": template}), model, store, **how)).select(*key, "yes", "confidence", "document_type")
