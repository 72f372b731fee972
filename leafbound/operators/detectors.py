"""Boundary detectors that users add, beside the built-in ones.

A detector is a function of pages that gives signals: one row (file_id, page_number, signal, confidence) for each hint that
a document starts on a page. It is registered by name with the weights of its signals; from then on its signals are
candidates like any other (b6), weigh in on pages (b7) and so change ranges (b9, b17).

Detectors are kept apart: what one gives is checked against the schema and written to the shared folder before others
see it, so one that raises, while it is planned or while it runs, is left out and reported, and the rest goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafbound.functions.shared import shared_dir

SCHEMA = {"file_id": None, "page_number": "int", "signal": "string", "confidence": "double"}


@dataclass(frozen=True)
class Detector:
    name: str
    detect: Callable[[DataFrame], DataFrame]
    weights: dict[str, float] = field(default_factory=dict)


REGISTERED: dict[str, Detector] = {}
#: What went wrong in the last run of each detector, by its name.
FAILURES: dict[str, str] = {}


def register(name: str, detect: Callable[[DataFrame], DataFrame], weights: dict[str, float] | None = None) -> None:
    """Adds a detector, or puts it in place of one of that name. Weights are by signal; others count half."""
    for signal, w in (weights or {}).items():
        if not 0 <= w:
            raise ValueError(f"weight of {signal}: {w}")
    REGISTERED[name] = Detector(name, detect, dict(weights or {}))


def unregister(name: str) -> None:
    REGISTERED.pop(name, None)
    FAILURES.pop(name, None)


def _checked(found: DataFrame, pages: DataFrame) -> DataFrame:
    missing = [c for c in SCHEMA if c not in found.columns]
    if missing:
        raise TypeError(f"signals lack {', '.join(missing)}")
    kinds = {c: dict(pages.dtypes)[c] if c == "file_id" else k for c, k in SCHEMA.items()}
    wrong = [f"{c} is {dict(found.dtypes)[c]}" for c in SCHEMA if c in ("signal", "file_id") and dict(found.dtypes)[c] != kinds[c]]
    if wrong:
        raise TypeError("; ".join(wrong))
    found = found.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    # Confidences are shares; a null or NaN one is no signal.
    return found.where(F.col("signal").isNotNull() & F.col("page_number").isNotNull() & (F.col("confidence") >= 0) & ~F.isnan("confidence")).withColumn("confidence", F.least("confidence", F.lit(1.0)))


def signals(pages: DataFrame) -> DataFrame | None:
    """The signals of all registered detectors over pages, with the detector's name as `plugin`; None where none is registered or all failed."""
    out: DataFrame | None = None
    for d in list(REGISTERED.values()):
        FAILURES.pop(d.name, None)
        try:
            found, path = _checked(d.detect(pages), pages), f"{shared_dir(pages.sparkSession)}/signals-{uuid.uuid4().hex}"
            found.write.parquet(path)
            found = pages.sparkSession.read.schema(found.schema).parquet(path).withColumn("plugin", F.lit(d.name))
        except Exception as e:  # whatever a user's function raises, here or on an executor
            FAILURES[d.name] = f"{type(e).__name__}: {e}".split("\n", 1)[0]
            continue
        out = found if out is None else out.unionByName(found)
    return out


def weights() -> dict[str, float]:
    return {s: w for d in REGISTERED.values() for s, w in d.weights.items()}
