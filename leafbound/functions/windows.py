"""Neighbours, running totals and ranges over the ordered rows of a file, without a window over a whole file.

A window by file puts all of a file's rows into one task. Here rows are dealt by blocks of their order; what crosses a
block's ends goes through a second window over the blocks' end rows only: a few in BLOCK of a file's rows. No frame is read
twice and nothing is joined. Files may be null; orders (page numbers) must differ within a file but may have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Pages of a block.
BLOCK = 2048


def _by(df: DataFrame, file: str, order: str, block: int) -> tuple[DataFrame, WindowSpec]:
    df = df.withColumn("_b", F.floor(F.col(order) / block))
    return df, Window.partitionBy(file, "_b").orderBy(order)


def beside(df: DataFrame, columns: list[str], back: int = 1, ahead: int = 0, file: str = "file_id", order: str = "page_number", block: int | None = None) -> DataFrame:
    """df with `before1` ... `before{back}` and `after1` ... `after{ahead}`: structs of the columns of the rows that many places off, null where there is none."""
    reach, row = max(back, ahead), F.struct(*columns)
    df, inside = _by(df, file, order, block or BLOCK)
    offsets = [(f"before{k}", F.lag, k) for k in range(1, back + 1)] + [(f"after{k}", F.lead, k) for k in range(1, ahead + 1)]
    end = F.lag(F.lit(1), reach).over(inside).isNull() | F.lead(F.lit(1), reach).over(inside).isNull()
    df = df.withColumns({name: f(row, k).over(inside) for name, f, k in offsets} | {"_end": end})
    ends = Window.partitionBy(file, F.when(F.col("_end"), F.lit(None)).otherwise(F.col("_b"))).orderBy(order)
    # A row that lacks a neighbour in its block is an end row, and so are all rows between it and that neighbour.
    df = df.withColumns({name: F.coalesce(F.col(name), F.when(F.col("_end"), f(row, k).over(ends))) for name, f, k in offsets})
    return df.drop("_b", "_end")


def running(df: DataFrame, name: str, value: Column, how: str = "sum", own: bool = True, file: str = "file_id", order: str = "page_number", block: int | None = None) -> DataFrame:
    """df with the running sum or maximum of a value: in the blocks, then over the blocks' totals, then both together. Without `own` the row itself isn't in it."""
    add = {"sum": F.sum, "max": F.max}[how]
    df, inside = _by(df, file, order, block or BLOCK)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    df = df.withColumn("_run_v", value)
    df = df.withColumns({"_run_in": add("_run_v").over(upto), "_run_all": add("_run_v").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_run_first": F.lag(F.lit(1)).over(inside).isNull()})
    heads = Window.partitionBy(file, F.when(F.col("_run_first"), F.lit(None)).otherwise(F.col("_b"))).orderBy(order)
    df = df.withColumn("_run_past", F.when(F.col("_run_first"), add("_run_all").over(heads.rowsBetween(Window.unboundedPreceding, -1))))
    df = df.withColumn("_run_past", F.max("_run_past").over(Window.partitionBy(file, "_b")))
    both = F.greatest("_run_in", "_run_past") if how == "max" else F.when(F.col("_run_in").isNotNull() | F.col("_run_past").isNotNull(), F.coalesce("_run_in", F.lit(0)) + F.coalesce("_run_past", F.lit(0)))
    return df.withColumn(name, both).drop("_run_v", "_run_in", "_run_all", "_run_first", "_run_past", "_b")


def ranges(pages: DataFrame, starts: str, last: str, file: str = "file_id", order: str = "page_number") -> DataFrame:
    """Rows that start a range, with its `start_page` and `end_page`: the page before the next start, or the file's last page.

    starts and last: boolean columns that mark starts and each file's last page; other rows are left out before anything is dealt.
    """
    marked = pages.where(F.coalesce(F.col(starts), F.lit(False)) | F.col(last)).withColumn("_s", F.coalesce(F.col(starts), F.lit(False)))
    marked = beside(marked, [order, "_s"], back=0, ahead=1, file=file, order=order)
    end = F.when(F.col("after1").isNull(), F.col(order)).when(F.col("after1._s"), F.col(f"after1.{order}") - 1).otherwise(F.col(f"after1.{order}"))
    return marked.where("_s").withColumns({"start_page": F.col(order), "end_page": end}).drop("after1", "_s", starts, last)
