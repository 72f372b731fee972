"""Mixing sources to target weights (native).

Weights run down a tree of domains, languages and sources. At each node the budget is shared among the
children by weight; a child that can't supply its share (its leaves' tokens times MAX_EPOCHS) is filled and
its shortage goes to its siblings first. A node's capacity is what its subtree holds, so only what no sibling
can take is left to the ancestors' other children. Each leaf then gives whole epochs and, of one more epoch,
the prefix of its documents in that epoch's seeded order whose words fit the rest of the budget.

The prefix is found without sorting a leaf in one task: documents are summed by leaf and the first three
hex digits of their order hash, the bucket in which the budget ends is found from those sums, and only that
bucket is summed row by row.

Tokens are words between ASCII white space. Defined cases: null languages and sources are nodes of their
own; very long texts count whole; documents without words supply nothing, and go with their leaf's epochs; rows with equal ids stand at
one place of the order and go together; a leaf of weight zero or less gives nothing; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, stored

MAX_EPOCHS, SEED, SHARE = 2, 17, 1.0
LEVELS = ["_domain", "_lang", "_source"]


def default_domain(source: Column) -> Column:
    """Stands for a catalogue's mapping of sources to domains: four groups by the first hex digit of the name's MD5."""
    digit = F.instr(F.lit("0123456789abcdef"), F.left(F.md5(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), F.lit(1))) - 1
    return F.concat(F.lit("domain"), F.floor(digit / 4).cast("string"))


def _placed(docs: DataFrame, id_col: str, lang_col: str, source_col: str, domain: Column | None) -> dict[str, Column]:
    none = F.lit("(none)")
    return {
        "_domain": F.coalesce((default_domain(F.col(f"`{source_col}`")) if domain is None else domain).cast("string"), none),
        "_lang": F.coalesce(F.col(f"`{lang_col}`").cast("string"), none),
        "_source": F.coalesce(F.col(f"`{source_col}`").cast("string"), none),
        "_key": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
    }


def _weight(cols: list[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == len(cols):
            same = F.lit(True)
            for c, v in zip(cols, path, strict=True):
                same = same & (F.col(c) == v)
            out = F.when(same, F.lit(float(w))).otherwise(out)
    return out


def _filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent..., name, w, cap, _budget of the parent): _budget becomes each node's share.

    With siblings in order of cap / w, the level at node i is (budget - caps before) / (weights from i on);
    the highest level is where the water stands.
    """
    by = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).asc_nulls_last(), name)
    level = (F.col("_budget") - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("_level", F.when(F.col("w") > 0, level))
    top = F.max("_level").over(Window.partitionBy(*parent))
    return nodes.withColumn("_budget", F.when(F.col("w") > 0, F.least(F.col("cap").cast("double"), F.col("w") * top)).otherwise(F.lit(0.0))).drop("_level")


def budgets(leaves: DataFrame, weights: Mapping[tuple[str, ...], float] | None = None, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (_domain, _lang, _source, tokens): with each leaf's budget in whole tokens. The table is one row a leaf."""
    weights = weights or {}
    leaves = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * epochs)
    for i in range(3, 0, -1):  # a subtree without weight has no capacity
        leaves = leaves.withColumn(f"_w{i}", _weight(LEVELS[:i], weights))
    usable = leaves.withColumn("cap", F.when((F.col("_w1") > 0) & (F.col("_w2") > 0) & (F.col("_w3") > 0), F.col("cap")).otherwise(0))
    total = leaves.agg((F.sum("tokens") * F.lit(float(share))).alias("_budget"))
    level = usable.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.first("_w1").alias("w")).crossJoin(F.broadcast(total))  # total is one row
    level = _filled(level, [], "_domain").select("_domain", "_budget")
    for i in (2, 3):
        nodes = usable.groupBy(*LEVELS[:i]).agg(F.sum("cap").alias("cap"), F.first(f"_w{i}").alias("w"))
        level = _filled(nodes.join(level, LEVELS[: i - 1]), LEVELS[: i - 1], LEVELS[i - 1]).select(*LEVELS[:i], "_budget")
    return leaves.select(*LEVELS, "tokens").join(level, LEVELS).select(*LEVELS, "tokens", F.floor("_budget").alias("budget"))


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def plan(rows: DataFrame, weights: Mapping[tuple[str, ...], float] | None = None, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """rows, stored: (_domain, _lang, _source, _key, _n). Per leaf: whole epochs, and the last order hash of the partial one."""
    leaves = stored(budgets(rows.groupBy(*LEVELS).agg(F.sum("_n").alias("tokens")), weights, share, epochs), "budgets")
    leaves = leaves.select(*LEVELS, F.floor(F.col("budget") / F.col("tokens")).alias("_full"), F.pmod("budget", "tokens").alias("_rest"))
    ordered = rows.join(if_small(leaves), LEVELS).where("_rest > 0").withColumn("_o", order_hash(seed, F.col("_full"), F.col("_key")))
    ordered = ordered.select(*LEVELS, "_rest", "_n", "_o", F.substring("_o", 1, 3).alias("_b"))
    sums = ordered.groupBy(*LEVELS, "_rest", "_b").agg(F.sum("_n").alias("_s"))
    ends = sums.withColumn("_to", F.sum("_s").over(Window.partitionBy(*LEVELS).orderBy("_b")))
    # the bucket that the budget doesn't fill; its predecessors go in whole
    ends = ends.where("_to > _rest").groupBy(*LEVELS).agg(F.min(F.struct("_b", (F.col("_to") - F.col("_s")).alias("_before"))).alias("e")).select(*LEVELS, "e.*")
    ends = stored(ends, "ends")
    last = ordered.join(if_small(ends), [*LEVELS, "_b"])
    upto = F.sum("_n").over(Window.partitionBy(*LEVELS, "_b").orderBy("_o"))  # rows of one order hash together
    cut = last.withColumn("_upto", F.col("_before") + upto).where("_upto <= _rest").groupBy(*LEVELS).agg(F.max("_o").alias("_cut"))
    cut = ends.join(cut, LEVELS, "left").select(*LEVELS, F.coalesce("_cut", "_b").alias("_cut"))  # the bare prefix precedes all of its bucket
    return stored(leaves.join(cut, LEVELS, "left").select(*LEVELS, "_full", "_cut"), "mix")


def _drawn(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """rows with _key and the tree's columns, once for each epoch that takes them (_epoch)."""
    rows = rows.join(if_small(leaves), LEVELS)
    part = order_hash(seed, F.col("_full"), F.col("_key")) <= F.col("_cut")
    n = F.col("_full") + F.coalesce(part, F.lit(False)).cast("long")
    return rows.withColumn("_epoch", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))).drop("_full", "_cut")


def _counted(docs: DataFrame, text_col: str, placed: dict[str, Column]) -> DataFrame:
    n = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(*[v.alias(k) for k, v in placed.items()], n.alias("_n"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, weights: Mapping[tuple[str, ...], float] | None = None, seed: int = SEED, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The chosen documents, once per epoch: id, domain, lang, source, n_tokens, epoch."""
    placed = _placed(docs, id_col, lang_col, source_col, domain)
    rows = stored(_counted(docs, text_col, placed | {"_id": F.col(f"`{id_col}`")}), "tokens")
    out = _drawn(rows, plan(rows, weights, share, epochs, seed), seed)
    return out.select(F.col("_id").alias(id_col), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_n").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, weights: Mapping[tuple[str, ...], float] | None = None, seed: int = SEED, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs that the mix takes, once per epoch, with docs' columns. Texts aren't shuffled."""
    placed = _placed(docs, id_col, lang_col, source_col, domain)
    rows = stored(_counted(docs, text_col, placed), "tokens")
    leaves = plan(rows, weights, share, epochs, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return _drawn(docs.select(row, *[v.alias(k) for k, v in placed.items()]), leaves, seed).select("_row.*")
