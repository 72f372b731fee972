"""Quality rules with host-level verdicts (native).

Every document is judged by its own figures; failures are then counted per host, the hosts' failure rates
shrunk with a beta prior fitted to all hosts (method of moments), and hosts whose shrunk rate is too high
lose all their documents.

Defined cases: a null text has no words and fails; null hosts form one host; repeated rows count each;
an empty table gives an empty result; other columns of the input are ignored by `measure` and kept by
`keep_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, stored, words

#: Shrunk failure rate above which a host's documents all go, and the least number of documents it takes.
HOST_LIMIT, HOST_LEAST = 0.6, 20
MIN_WORDS = 50
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _with_figures(df: DataFrame, text: Column) -> DataFrame:
    """df and a column _fig: the five figures of each text. Row by row, no shuffle.

    Trigrams are held as 64-bit hashes within one document. Positions are sorted by hash, so that texts of
    any length take n log n steps. Columns that a lambda refers to are made in a projection of their own.
    """
    p = "_qr"
    df = df.withColumn(f"{p}_t", F.coalesce(text, F.lit("")))
    df = df.withColumn(f"{p}_w", words(F.col(f"{p}_t")))
    df = df.withColumn(f"{p}_l", F.filter(F.split(f"{p}_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(
        f"{p}_h",
        F.expr(f"CASE WHEN size({p}_w) < 3 THEN array() ELSE transform(sequence(0, size({p}_w) - 3), i -> xxhash64({p}_w[i], {p}_w[i + 1], {p}_w[i + 2])) END"),
    )
    df = df.withColumn(
        f"{p}_s",
        F.expr(f"CASE WHEN size(array_distinct({p}_h)) < size({p}_h) THEN sort_array(transform({p}_h, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    df = df.withColumn(
        f"{p}_p",
        F.expr(
            f"CASE WHEN {p}_s IS NULL THEN array() ELSE transform(filter({p}_s, (x, k) -> (k > 0 AND {p}_s[k - 1].h = x.h) OR (k + 1 < size({p}_s) AND {p}_s[k + 1].h = x.h)), x -> x.i) END"
        ),
    )
    n_repeat = F.expr(f"CASE WHEN size({p}_p) = 0 THEN 0 ELSE size(array_distinct(concat({p}_p, transform({p}_p, i -> i + 1), transform({p}_p, i -> i + 2)))) END")
    fig = F.struct(
        F.size(f"{p}_w").cast("long").alias("n_words"),
        F.char_length(F.array_join(f"{p}_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(f"{p}_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(f"{p}_l") - F.size(F.array_distinct(f"{p}_l"))).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
    )
    return df.withColumn("_fig", fig).drop(*[f"{p}_{x}" for x in "twlhsp"])


def failed(fig: str = "_fig") -> Column:
    return (F.col(f"{fig}.n_words") < MIN_WORDS) | (100 * F.col(f"{fig}.n_repeat_words") > 50 * F.col(f"{fig}.n_words"))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT, least: int = HOST_LEAST) -> DataFrame:
    """rows: (_host, _bad). Per host: its shrunk failure rate and whether it is rejected.

    With host rates of mean m and variance v (weighted by documents), the prior's strength is
    m (1 - m) / v - 1, at least 1. One hot host is a partial sum in every task.
    """
    hosts = rows.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("_bad").cast("long")).alias("k"))
    prior = hosts.agg(
        (F.sum("k") / F.sum("n")).alias("m"),
        (F.sum(F.col("k") * F.col("k") / F.col("n")) / F.sum("n") - F.pow(F.sum("k") / F.sum("n"), F.lit(2.0))).alias("v"),
    ).select("m", F.when(F.col("v") > 1e-12, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0))).otherwise(F.lit(1e6)).alias("s"))
    # prior is one row, so this join multiplies nothing
    rate = (F.col("k") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    return hosts.join(F.broadcast(prior)).select("_host", rate.alias("host_rate"), ((rate > limit) & (F.col("n") >= least)).alias("host_rejected"))


def _judged(marked: DataFrame) -> DataFrame:
    """marked, with _host and _bad, and the host's verdict joined on; null hosts meet as one value."""
    hosts = stored(host_verdicts(marked.select("_host", "_bad")), "hosts")
    return marked.join(if_small(hosts), "_host")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: its id, the five figures, base_failed, kept, host_rate."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")).alias("_host"))
    rows = _with_figures(rows, F.col("_text")).select("_id", "_host", "_fig", failed().alias("_bad"))
    out = _judged(stored(rows, "figures"))
    return out.select(
        F.col("_id").alias(id_col), *[F.col(f"_fig.{c}").alias(c) for c in FIGURES], F.col("_bad").alias("base_failed"),
        (~F.col("_bad") & ~F.col("host_rejected")).alias("kept"), F.round("host_rate", 9).alias("host_rate"),
    )


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row).withColumn("_host", F.coalesce(F.col(f"_row.`{host_col}`").cast("string"), F.lit("\x00")))
    rows = _with_figures(rows, F.col(f"_row.`{text_col}`")).select("_row", "_host", failed().alias("_bad"))
    out = _judged(stored(rows, "judged")).where(~F.col("_bad") & ~F.col("host_rejected"))
    return out.select("_row.*")
