"""Joins of points with intervals and of intervals with each other, by bins.

An interval stands in every bin that it touches, a point in one; rows meet on equal file and bin, so a file's pages and
ranges are dealt over many tasks, and a bin holds what overlaps in BIN pages only. Long intervals are no trouble: one
of n pages makes n / BIN rows. Files may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages of a bin.
BIN = 256


def _bin(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("bigint")


def _keys(df: DataFrame, file: str, bins: Column) -> DataFrame:
    """Columns that are never null, for the null file is a file, too."""
    return df.withColumns({"_bin": bins, "_f": F.coalesce(F.col(file).cast("string"), F.lit("")), "_none": F.col(file).isNull()})


def cover(points: DataFrame, intervals: DataFrame, at: str = "page_number", start: str = "start_page", end: str = "end_page", file: str = "file_id", size: int | None = None) -> DataFrame:
    """Each point with each interval of its file that holds it. The interval's file column goes; other columns must have different names."""
    size = size or BIN
    p = _keys(points, file, _bin(F.col(at), size))
    i = _keys(intervals.where(F.col(start) <= F.col(end)), file, F.explode(F.sequence(_bin(F.col(start), size), _bin(F.col(end), size)))).drop(file)
    return p.join(i, ["_f", "_none", "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_f", "_none", "_bin")


def overlap(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], file: str = "file_id", size: int | None = None) -> DataFrame:
    """Each pair of intervals of a file that share a page, once: in the bin in which the later of the two starts. right's file column goes."""
    size, (a, b), (c, d) = size or BIN, left_ends, right_ends
    bins = lambda s, e: F.explode(F.sequence(_bin(F.col(s), size), _bin(F.col(e), size)))
    x = _keys(left.where(F.col(a) <= F.col(b)), file, bins(a, b))
    y = _keys(right.where(F.col(c) <= F.col(d)), file, bins(c, d)).drop(file)
    both = x.join(y, ["_f", "_none", "_bin"]).where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)))
    return both.where(F.col("_bin") == _bin(F.greatest(a, c), size)).drop("_f", "_none", "_bin")
