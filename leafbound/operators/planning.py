"""Where expensive reading is worth its cost: plans, samples, orders, presets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.windows import beside, running
from leafbound.operators.pairs import near, short_files
from leafbound.plans.ops import op, view

#: Seconds a page costs by strategy.
COST = {"high": "15", "medium": "8", "fast": "3", "skip": "0.1"}
#: Image quality profiles (least quality, dpi, steps, gpu, batch).
PROFILES = [
    ("excellent", "0.85", 150, "deskew", False, 8), ("good", "0.7", 200, "deskew,contrast", False, 4), ("fair", "0.5", 300, "deskew,denoise,contrast", True, 2),
    ("poor", "0.3", 300, "upscale,denoise,deskew,contrast,threshold", True, 1), ("very_poor", "0.0", 400, "upscale,denoise,deskew,contrast,threshold,borders", True, 1),
]
#: Pipeline profiles (dpi, engine, threshold, batch).
PIPELINES = [("llm", 250, "easyocr", "0.6", 2), ("splitter", 150, "tesseract-cli", "0.5", 4), ("rag", 300, "easyocr", "0.7", 8), ("test", 200, "tesseract-cli", "0.7", 4)]
#: Detector presets, plugin weights in each (construction, rule, llm, vlm), least confidence and signals of the rules.
PRESETS = [
    ("construction", "1.5", "1.0", "0.7", "0.0", "0.6", 1), ("general", "0.8", "1.0", "1.0", "0.0", "0.6", 1), ("high_accuracy", "1.2", "1.0", "1.1", "0.9", "0.7", 2), ("fast", "1.0", "1.0", "0.0", "0.0", "0.5", 1), ("llm_only", "0.0", "0.0", "1.0", "0.0", "0.6", 1),
]
#: Deployment modes (temperature, tokens, characters a page, window, batch, weights of model and rules).
MODES = [
    ("development", "0.1", 4096, 1000, 3, 3, "0.9", "0.7"), ("production", "0.1", 4096, 800, 2, 5, "0.85", "0.8"), ("high_perf", "0.2", 2048, 500, 1, 10, "0.8", "0.9"), ("high_accuracy", "0.05", 6144, 1200, 4, 2, "0.95", "0.6"), ("low_resource", "0.3", 1024, 300, 1, 15, "0.7", "1.0"),
]


def rows(names: list[str], values: list[tuple]) -> str:
    lit = lambda v: "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else f"{v}D" if v.replace(".", "", 1).isdigit() else f"'{v}'"
    return " UNION ALL ".join("SELECT " + ", ".join(f"{lit(v)} AS {n}" for n, v in zip(names, r, strict=True)) for r in values)


op("o1_page_needs_ocr", "Pages with hardly any text under large images.", r"""
SELECT file_id, page_number, CASE WHEN n > 50 THEN false WHEN image_share > 0.8D THEN true ELSE false END AS needs_ocr, CASE WHEN n > 50 THEN 'has text' WHEN image_share > 0.8D THEN 'image page' ELSE 'little content' END AS reason
FROM (SELECT file_id, page_number, length(regexp_replace(text, r'^\s+|\s+$', '')) AS n, cast(doc_id % 10 AS double) / 10 AS image_share FROM {pages_seeded})""", per_page=True)
view("file_pages", "How many pages each file has.", "SELECT file_id, count(*) AS n FROM {pages_doc} GROUP BY file_id")
_sampled = "page_number - 1 IN (0, cast(floor(n / 5D) AS int), cast(floor(2 * n / 5D) AS int), cast(floor(3 * n / 5D) AS int), cast(floor(4 * n / 5D) AS int))"
op("o2_pdf_needs_ocr", "Whether half of five evenly placed pages need it.", f"SELECT file_id, count(*) AS sampled, (avg(CASE WHEN needs_ocr THEN 1D ELSE 0D END) >= 0.5D) AS needs_ocr FROM (SELECT p.file_id, page_number, needs_ocr, n FROM {{o1_page_needs_ocr}} p JOIN {{file_pages}} f ON p.file_id IS NOT DISTINCT FROM f.file_id) WHERE n <= 5 OR {_sampled} GROUP BY file_id")
op("o3_sample_linspace", "Five pages from first to last, evenly.", "SELECT DISTINCT file_id, i, cast(floor(i * (n - 1) / 4D) AS bigint) AS page_index FROM (SELECT file_id, n, explode(sequence(0, 4)) AS i FROM (SELECT file_id, count(*) AS n FROM {pages_doc} GROUP BY file_id) WHERE n > 5)")


def first_unread(pages: DataFrame, most: int) -> DataFrame:
    """Which pages that need reading are among the first `most` of their file."""
    counted = running(pages, "_n", F.col("needs_ocr").cast("int"))
    return counted.select("file_id", "page_number", "needs_ocr", (F.col("needs_ocr") & (F.col("_n") <= most)).alias("chosen"))


op("o4_ocr_page_limit", "The first three pages of a file that need reading; the others wait.", lambda o1_page_needs_ocr: first_unread(o1_page_needs_ocr, 3))
view("page_content", "Whether each page has text and images.", r"SELECT file_id, page_number, length(regexp_replace(text, r'^\s+|\s+$', '')) > 50 AS t, has_images AS i FROM {pages_seeded}", per_page=True)
op("o5_analyze_document", "Pages with text, images, both or neither, and what that makes of the file.", r"""
SELECT file_id, count(*) AS total, count_if(t AND NOT i) AS text_pages, count_if(i AND NOT t) AS image_pages, count_if(t AND i) AS mixed_pages, count_if(NOT t AND NOT i) AS empty_pages,
  CASE WHEN count_if(i AND NOT t) > count(*) * 0.8D THEN 'image-based' WHEN count_if(t AND NOT i) > count(*) * 0.8D THEN 'text-based' ELSE 'mixed' END AS kind
FROM {page_content} GROUP BY file_id""")

def critical(page_facts: DataFrame) -> DataFrame:
    """Every page with whether it may start a document, is near one that may, or is of a short file."""
    pages = beside(page_facts.select("file_id", "page_number", "n_chars", "has_images", "promising"), ["page_number"], back=1, ahead=1)
    pages = pages.withColumn("potential", F.col("promising") | F.col("before1").isNull() | F.col("after1").isNull()).drop("before1", "after1")
    return short_files(beside(pages, ["potential"], back=2, ahead=2).withColumn("near", near("potential", 2)), 10)


view("critical_pages", "What the plan of a file goes by.", critical)
op("o6_profile_document", "What a plan needs to know of a file.", "SELECT file_id, count(*) AS pages, cast(sum(n_chars) AS bigint) AS n_chars, count_if(potential) AS potential, count_if(n_chars > 500) AS long_pages FROM {critical_pages} GROUP BY file_id")
op("o7_critical_pages", "How well each page must be read, and why.", """
SELECT file_id, page_number, CASE WHEN potential THEN 'high' WHEN near OR short THEN 'medium' WHEN n_chars > 500 AND NOT has_images THEN 'skip' ELSE 'fast' END AS strategy,
  CASE WHEN potential THEN 'potential_boundary' WHEN short THEN 'small_document' WHEN near THEN 'boundary_context' WHEN n_chars > 500 AND NOT has_images THEN 'has_embedded_text' ELSE 'default' END AS reason FROM {critical_pages}""")
op("o8_page_strategy", "Pages by strategy of each file.", "SELECT file_id, count_if(strategy = 'high') AS high, count_if(strategy = 'medium') AS medium, count_if(strategy = 'fast') AS fast, count_if(strategy = 'skip') AS skipped FROM {o7_critical_pages} GROUP BY file_id")


def reading_order(planned: DataFrame) -> DataFrame:
    """Pages that aren't skipped, numbered in the order they are read: those to be read best first, then by page."""
    ranks = {"high": 1, "medium": 2}
    read = planned.where("strategy <> 'skip'").select("file_id", "page_number", "strategy", *[(F.col("strategy") == k).cast("int").alias(k) for k in ranks])
    for name, own in (("_high", F.col("high")), ("_medium", F.col("medium")), ("_rest", 1 - F.col("high") - F.col("medium"))):
        read = running(read, name, own)
    totals = planned.groupBy(F.col("file_id").alias("_file")).agg(*[F.count_if(F.col("strategy") == k).alias(f"n_{k}") for k in ranks])
    read = read.join(totals, F.col("file_id").eqNullSafe(F.col("_file")))
    position = F.when(F.col("high") == 1, F.col("_high")).when(F.col("medium") == 1, F.col("n_high") + F.col("_medium")).otherwise(F.col("n_high") + F.col("n_medium") + F.col("_rest"))
    return read.select("file_id", "page_number", "strategy", position.cast("bigint").alias("position"))


op("o9_processing_order", "Pages in the order they are read; skipped ones aren't.", lambda o7_critical_pages: reading_order(o7_critical_pages))
op("o10_estimated_time", "Seconds a file will take.", f"SELECT file_id, bround(sum(CASE strategy {' '.join(f"WHEN '{k}' THEN {v}D" for k, v in COST.items())} ELSE 5D END), 6) AS seconds FROM {{o7_critical_pages}} GROUP BY file_id")
op("o11_adaptive_ocr_config", "Each page's configuration when a model decides.", "SELECT file_id, page_number, CASE WHEN high_quality OR llm THEN 'high' ELSE 'fast' END AS config FROM {w7_near_boundary}")
op("o12_select_configuration", "The preset for a file by its first ten pages.", """
SELECT a.file_id, CASE WHEN h.construction THEN 'construction' WHEN a.scanned THEN 'high_accuracy' WHEN a.n > 100 THEN 'fast' WHEN a.tables AND a.images THEN 'high_accuracy' ELSE 'general' END AS preset, a.mean_words
FROM (SELECT file_id, count(*) AS n, bround(avg(word_count), 6) AS mean_words, bool_or(has_tables) AS tables, bool_or(has_images) AS images, bool_or(word_count < 50 AND has_images) AS scanned FROM {pages_seeded} WHERE page_number <= 10 GROUP BY file_id) a JOIN {t10_type_hints} h ON a.file_id IS NOT DISTINCT FROM h.file_id""")
view("profiles", "Quality profiles.", rows(["level", "least", "dpi", "steps", "gpu", "batch"], PROFILES))
view("file_quality", "A file's quality, skew and noise, by what is known of its pages; the mean is exact, as profiles begin at values that it may meet.", "SELECT file_id, cast(avg(coalesce(cast(ocr_confidence AS decimal(18, 12)), 0.5BD)) AS double) AS quality, cast(min(doc_id) % 4 AS double) AS skew, cast(max(doc_id) % 30 AS double) AS noise, count(*) AS pages, bool_or(has_tables) AS tables, min(doc_id) % 5 = 0 AS handwritten FROM {pages_seeded} GROUP BY file_id")
op("o14_generate_config", "The profile for a file's quality, with adjustments.", """
SELECT q.file_id, p.level, p.dpi + CASE WHEN q.tables THEN 50 ELSE 0 END AS dpi, concat(p.steps, CASE WHEN q.skew > 1 AND NOT contains(p.steps, 'deskew') THEN ',deskew' ELSE '' END, CASE WHEN q.noise > 20 AND NOT contains(p.steps, 'denoise') THEN ',denoise' ELSE '' END) AS steps, CASE WHEN q.pages > 100 THEN p.batch * 2 ELSE p.batch END AS batch
FROM {file_quality} q JOIN (SELECT p.*, coalesce(lag(least) OVER (ORDER BY least DESC), 2D) AS below FROM {profiles} p) p ON q.quality >= p.least AND q.quality < p.below""")
op("o15_engine_select", "Which engine reads a file.", "SELECT file_id, CASE WHEN handwritten OR quality < 0.3D THEN 'easyocr' WHEN pages > 50 THEN 'tesseract-cli' ELSE 'easyocr' END AS engine FROM {file_quality}")
op("o18_parallel_strategy", "Workers and batches by a file's size.", "SELECT file_id, CASE WHEN count(*) < 10 THEN 'small' ELSE 'medium' END AS size, CASE WHEN count(*) < 10 THEN 2 ELSE 4 END AS workers, CASE WHEN count(*) < 10 THEN 2 ELSE 4 END AS batch FROM {pages_doc} GROUP BY file_id")
op("o19_profiles", "Pipeline profiles.", rows(["profile", "dpi", "engine", "threshold", "batch"], PIPELINES))
view("modes", "Deployment modes.", rows(["mode", "temperature", "max_tokens", "page_chars", "context", "batch", "llm_weight", "rule_weight"], MODES))
op("o20_deployment_presets", "Deployment modes, plain and with the focus on construction papers.", "SELECT mode, focus, temperature, max_tokens, CASE WHEN focus THEN least(1200, page_chars + 200) ELSE page_chars END AS page_chars, CASE WHEN focus THEN least(4, context + 1) ELSE context END AS context, batch, llm_weight, rule_weight FROM (SELECT m.*, explode(array(true, false)) AS focus FROM {modes} m)")
op("o21_detector_presets", "Detector presets.", rows(["preset", "construction", "rule", "llm", "vlm", "min_confidence", "min_signals"], PRESETS))
op("o22_indicator_pages", "Pages with a word of the model's list, by file.", "SELECT file_id, count_if(indicated) AS n FROM {page_facts} GROUP BY file_id")
RANK = "CASE priority WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END"
view("waiting_tasks", "Waiting tasks with the hour in which they came.", f"SELECT task_id, priority, {RANK} AS rank, ts, ((year(ts) * 100 + month(ts)) * 100 + day(ts)) * 100 + hour(ts) AS hour FROM {{tasks}} WHERE status = 'pending'")


def queue_hours(by: str) -> str:
    """SQL for the number of tasks that stand before each hour of each value of a column."""
    return f"""SELECT h.{by}, h.hour, t.before + h.before AS before FROM (SELECT {by}, hour, sum(n) OVER (PARTITION BY {by} ORDER BY hour ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT {by}, hour, count(*) AS n FROM {{waiting_tasks}} GROUP BY {by}, hour)) h
JOIN (SELECT {by}, sum(n) OVER (ORDER BY {by} ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT {by}, count(*) AS n FROM {{waiting_tasks}} GROUP BY {by})) t ON h.{by} IS NOT DISTINCT FROM t.{by}"""


view("rank_hours", "Tasks before each hour of a rank.", queue_hours("rank"))
view("spelled_hours", "Tasks before each hour of a priority by its spelling.", queue_hours("priority"))
op("task_queue_order", "Waiting tasks in the order they are taken: by meaning of the priority, or by its spelling as a flag asks.", """
SELECT w.task_id, w.priority, cast(r.before + w.n AS bigint) AS position, cast(s.before + w.m AS bigint) AS spelled_position
FROM (SELECT task_id, priority, rank, hour, row_number() OVER (PARTITION BY rank, hour ORDER BY ts, task_id) AS n, row_number() OVER (PARTITION BY priority, hour ORDER BY ts, task_id) AS m FROM {waiting_tasks}) w
JOIN {rank_hours} r ON w.rank = r.rank AND w.hour IS NOT DISTINCT FROM r.hour JOIN {spelled_hours} s ON w.priority IS NOT DISTINCT FROM s.priority AND w.hour IS NOT DISTINCT FROM s.hour""")
op("task_status", "Where each user's latest task stands.", "SELECT user_id, max_by(status, struct(ts, task_id)) AS status, count(*) AS n_events FROM {tasks} GROUP BY user_id")
