"""Every query of the segmentation engine by name, with SQL that says the same where SQL can."""

import uuid

from pyspark.sql import functions as F

from leafbound.functions.shared import shared_dir, stored
from leafbound.operators import catalogue, models  # noqa: F401  (declares the operators)
from leafbound.operators.fusion import merge_verdicts
from leafbound.operators.repair import correction_suggestions
from leafbound.oracles import TEXTS, oracle
from leafbound.plans.ops import OPS, apply, over_tables
from leafbound.sources.samples import TEMPLATES, stand_in


def _p10(spark, sf_dir):
    return correction_suggestions(apply("ocr_pages", documents=spark.read.parquet(f"{sf_dir}/documents.parquet")))


def b16_model_merge(spark, sf_dir):
    """Ranges by the rules and by a model that is asked about every page that the rules can't settle. Rules read the texts once: what they say of pages is stored."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = stored(apply("rule_pages", documents=documents), shared_dir(spark), "rules")
    pages, texts = apply("b15_ambiguous_cases", rule_pages=rules), apply("page_cuts", documents=documents).select("file_id", "page_number", F.col("current").alias("text"))
    said = models.judge(pages, texts, TEMPLATES["structured"], stand_in, f"{shared_dir(spark)}/replies-{uuid.uuid4().hex}")
    return merge_verdicts(rules, said)


QUERIES = {n: over_tables(n) for n, o in OPS.items() if o.query} | {"p10_correction_suggestions": _p10, "b16_model_merge": b16_model_merge}
ORACLES = {n: oracle(n) for n in QUERIES if n in TEXTS}
