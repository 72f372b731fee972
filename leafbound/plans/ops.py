"""Operators over named inputs, each one SELECT or one function of DataFrames.

The inputs of a SELECT stand in braces, those of a function are its parameters' names: base tables, derived views or other
operators. Every input is a DataFrame, so a chain of operators is one lazy plan that Catalyst optimises as a
whole; `apply` runs any operator over DataFrames of the caller's own.

Operators marked `per_page` look at one page at a time and give one row for it. Over the base tables they run before pages
are numbered: file_id and page_number stand for a page's place then (see sources/pages.py), and only what they
give is dealt out and numbered, never the text.
"""

from __future__ import annotations

import importlib
import inspect
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
_INPUT = re.compile(r"\{([a-z]\w*)\}")


@dataclass(frozen=True)
class Op:
    name: str
    about: str
    sql: str | None
    build: Callable[..., DataFrame] | None
    query: bool  # whether it is offered as a query, not only as an input
    per_page: bool
    given: tuple[str, str] | None = None  # an input that callers may hand in, and the SELECT that holds then

    @property
    def inputs(self) -> list[str]:
        return list(inspect.signature(self.build).parameters) if self.build else list(dict.fromkeys(_INPUT.findall(self.sql)))


OPS: dict[str, Op] = {}


def op(name: str, about: str, what: str | Callable[..., DataFrame], query: bool = True, per_page: bool = False, given: tuple[str, str] | None = None) -> None:
    if name in OPS or name in TABLES:
        raise ValueError(f"{name} is taken")
    text = isinstance(what, str)
    OPS[name] = Op(name, about, what.strip() if text else None, None if text else what, query, per_page, given)


def view(name: str, about: str, what: str | Callable[..., DataFrame], per_page: bool = False, given: tuple[str, str] | None = None) -> None:
    op(name, about, what, query=False, per_page=per_page, given=given)


def needed(name: str) -> dict[str, None]:
    """The operator and all that it is made of, inputs first."""
    seen: dict[str, None] = {}

    def visit(n: str) -> None:
        for i in OPS[n].inputs:
            if i in OPS and i not in seen:
                visit(i)
        seen[n] = None

    visit(name)
    return seen


def apply(name: str, **frames: DataFrame) -> DataFrame:
    """The operator over given DataFrames; inputs that aren't given are derived from others that are."""
    importlib.import_module("leafbound.operators.catalogue")  # declares the operators
    from leafbound.sources.pages import numbered

    spark = next(iter(frames.values())).sparkSession if frames else SparkSession.active()
    ops = {n: replace(o, sql=o.given[1], build=None, per_page=False) if o.given and o.given[0] in frames else o for n, o in OPS.items()}
    made: dict[tuple[str, bool], DataFrame] = {}
    views: list[str] = []

    def early(n: str) -> bool:
        """Whether n can be computed before its pages are numbered."""
        return n in ops and ops[n].per_page and n not in frames and all(i == "documents" and i in frames or early(i) for i in ops[n].inputs)

    def frame(n: str, raw: bool) -> DataFrame:
        if (n, raw) not in made:
            made[n, raw] = frames[n] if n in frames else compute(n, raw)
        return made[n, raw]

    def compute(n: str, raw: bool) -> DataFrame:
        if n not in ops:
            raise KeyError(f"{name} needs {n}")
        o, first = ops[n], early(n)
        inputs = {i: frame(i, first) for i in o.inputs}
        if o.build:
            out = o.build(**inputs)
        else:
            names = {i: f"leafbound_{i}_{uuid.uuid4().hex[:12]}" for i in inputs}
            for i, v in names.items():
                inputs[i].createOrReplaceTempView(v)
                views.append(v)
            out = spark.sql(_INPUT.sub(lambda m: names[m[1]], o.sql))
        return out if raw or not first else numbered(out, frames["documents"])

    try:
        return frame(name, False)
    finally:
        for v in views:
            spark.catalog.dropTempView(v)


def over_tables(name: str):
    """A query: the operator over a folder of base tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {i for n in needed(name) for i in OPS[n].inputs if i in TABLES}
        return apply(name, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(tables)})

    run.__name__, run.__doc__ = name, OPS[name].about
    return run
