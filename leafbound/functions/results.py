"""Results that are kept by what they were computed from, and counters that come with a pass that runs anyway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def computed_once(pages: DataFrame, compute: Callable[[DataFrame], DataFrame], store: str, content: list[str], config: str = "") -> DataFrame:
    """pages with the results of `compute`, which sees only pages whose content and configuration were never seen before.

    compute gives, for pages with a column `content_key`, that key and its results: one row for each key. content: the columns
    that results hang on. store: a folder that all executors share; results are added to it, and an entry is never changed. Equal pages
    are computed once. Two runs at a time may both compute a page; one of its entries counts then.
    """
    key = F.sha2(F.to_json(F.struct(F.lit(config).alias("c"), *[F.col(c) for c in content]), {"ignoreNullFields": "false"}), 256)
    keyed = pages.withColumn("content_key", key)
    spark = pages.sparkSession
    try:
        seen = spark.read.parquet(store).select("content_key").distinct()
    except AnalysisException:  # the first run
        seen = keyed.select("content_key").limit(0)
    new = keyed.dropDuplicates(["content_key"]).join(seen, "content_key", "left_anti")
    compute(new).write.mode("append").parquet(store)
    results = spark.read.parquet(store).dropDuplicates(["content_key"])
    return keyed.join(results.drop(*[c for c in results.columns if c in pages.columns]), "content_key", "left").drop("content_key")


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and what is counted while it is next computed: `.get` of the second has it afterwards. No pass of its own."""
    o = Observation(name)
    return df.observe(o, *[c.alias(n) for n, c in metrics.items()]), o


def page_counters(scored: DataFrame, name: str = "pages") -> tuple[DataFrame, Observation]:
    """scored: (text, overall). Pages, those with text, those of low confidence and the mean, beside whatever is done with the pages."""
    return observed(scored, name, pages=F.count(F.lit(1)), read=F.count_if(F.col("text") != ""), low=F.count_if(F.col("overall") < 0.6), mean_confidence=F.bround(F.avg("overall"), 6))
