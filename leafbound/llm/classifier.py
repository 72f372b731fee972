"""Quality classifier by co-training: texts and page metadata teach each other.

Two views of a document that share nothing: what its text says and looks like (words and stems, hashed, by presence;
repetition, line lengths, shares of capitals, digits, marks and white space, compressed size), and what its
record says (language, source, n_chars). Active dimensions of both are computed once per document and stored.

A logistic model on each view starts from a bounded sample of labelled documents. In each of ROUNDS rounds either
view labels all documents outside that sample of which it is sure (margin beyond SURE), and the other takes
STEPS steps on its labelled documents and those. A step is one pass: tasks add up gradients and curvature
bounds of their documents, Spark adds these by dimension, and each weight moves by gradient over bound, which
never raises the loss. Labelled and taught documents weigh the same, as do the classes; a view that is sure of one
class only teaches nothing in that round. The margins of both views are calibrated on labelled documents kept out of
training and combined by a small logistic model, fitted there too. Then every document is scored. The same
is done for the second label (toxic).

Bounded is the labelled sample alone: the first LABELLED documents by a hash of the id, and of these as many as have
LABELLED_BYTES of dimensions together. Labels beyond it are not read; their documents are taught like any
other. Nothing depends on the partitioning but the order in which sums are added.

Defined cases: null and empty texts score by what is left of their record; null languages, sources and
lengths are values of their own; very long texts are read whole; labels without documents, null labels and
repeated labels (the least counts) do no harm; of documents of one labelled id one is learned from; a label with
fewer than two classes scores its share; repeated rows repeat; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import stored

#: The labelled sample, in documents and in bytes of their dimensions.
LABELLED, LABELLED_BYTES = 6000, 64 << 20
ROUNDS, STEPS, KEEP = 3, 2, 0.5
#: Dimensions are stored as 16-bit numbers. A step's sums have both views' dimensions and two places for counts.
TEXT_DIMS, PAGE_DIMS = 1 << 16, 96
DIMS = TEXT_DIMS + PAGE_DIMS + 2
SHAPES = 112
#: What an active dimension counts: a word little, so that many together don't saturate the model; a figure of the text's shape more.
VALUE, SHAPE_VALUE = 0.2, 0.6
#: The margin from which a pseudo-label is passed on.
SURE = 2.0
#: Documents that a task handles at once.
BLOCK = 1000
_PUNCTUATION = bytes(32 if i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 128 else (i + 32 if 65 <= i < 91 else i) for i in range(256))
_KINDS = bytes(1 if 65 <= i < 91 else 2 if 48 <= i < 58 else 3 if i in b" \t\n\r\x0b\x0c" else 4 if i < 128 and not 97 <= i < 123 else 0 for i in range(256))


def _steps(x: float, at: tuple) -> int:
    return sum(x >= a for a in at)


def text_view(text: str | None, seen: dict | None = None) -> np.ndarray:
    """Active dimensions of a text: its words and their stems (the first five bytes), hashed, each once; its shape; 0 is the constant."""
    seen = {} if seen is None else seen
    raw = (text or "").encode("utf-8", "replace")
    words, n = raw.translate(_PUNCTUATION).split(), max(1, len(raw))
    own = set(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))
    kinds = raw.translate(_KINDS)
    upper, digit, space, mark = (kinds.count(i) / n for i in (1, 2, 3, 4))
    shares = (0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5)
    out = {
        0, 1 + 8 * _steps(len(words), (5, 15, 50, 200, 1000)) + _steps(len(own) / max(1, len(words)), (0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8)), 51 + _steps(again, (0.01, 0.03, 0.1, 0.3)),
        56 + _steps(n / (raw.count(b"\n") + 1), (20, 60, 150, 300, 600, 1200, 5000)), 64 + _steps(upper, shares), 72 + _steps(mark, shares), 80 + _steps(digit, shares),
        88 + _steps(space, (0.05, 0.1, 0.13, 0.16, 0.2, 0.3)), 96 + _steps(len(zlib.compress(raw, 1)) / n, (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    }
    for w in own:
        ij = seen.get(w)
        if ij is None:
            if len(seen) > 300_000:
                seen.clear()
            ij = seen[w] = [SHAPES + zlib.crc32(x) % (TEXT_DIMS - SHAPES) for x in {w, w[:5] + b"~"}]
        out.update(ij)
    return np.sort(np.fromiter(out, np.uint16, len(out)))


def page_view(lang: str | None, source: str | None, length: float | None) -> np.ndarray:
    """Active dimensions of a page's record. Nothing here reads the text."""
    known = length is not None and length == length
    return np.array([
        0, 1 + (7 if lang is None else zlib.crc32(lang.encode()) % 7), 9 + (63 if source is None else zlib.crc32(source.encode()) % 63),
        73 + _steps(length, (1, 50, 200, 500, 1500, 5000, 20000, 80000)) if known else 82,
    ], np.uint16)


def _rows(views) -> tuple[np.ndarray, np.ndarray]:
    """Active dimensions of documents, stored as bytes, in one array, and the document that each belongs to."""
    views = list(views)
    return np.frombuffer(b"".join(views), np.uint16).astype(np.int64), np.repeat(np.arange(len(views)), [len(v) // 2 for v in views])


class Logistic:
    """Logistic regression on rows of active dimensions."""

    def __init__(self, dims: int, shapes: int = 0, decay: float = 1e-4):
        self.w, self.decay = np.zeros(dims), decay
        self.value = np.where(np.arange(dims) < shapes, SHAPE_VALUE, VALUE)

    def margins(self, x: tuple) -> np.ndarray:
        idx, row = x
        return np.bincount(row, (self.w * self.value)[idx], minlength=row[-1] + 1 if len(row) else 0)

    def fit(self, x: tuple, y: np.ndarray, steps: int = 100, rate: float = 0.3) -> Logistic:
        """By Adam over all rows at once, from where the weights are."""
        idx, row = x
        weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))
            g = self.value * np.bincount(idx, ((p - y) * weight)[row], minlength=len(self.w)) + self.decay * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def slopes(self, x: tuple, label: float, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient, and bound of the curvature along each dimension, of the rows `use` labelled `label`, added up.

        A row's part is bounded by the sum of its values times each of them, at the steepest place of the logistic
        curve; so all dimensions may move at once.
        """
        idx, row = x
        p = 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))
        g = np.where(use, p - label, 0.0)
        h = np.where(use, 0.25 * np.bincount(row, self.value[idx], minlength=len(use)), 0.0)
        return tuple(self.value * np.bincount(idx, x[row], minlength=len(self.w)) for x in (g, h))

    def move(self, g: np.ndarray, h: np.ndarray) -> None:
        self.w -= (g + self.decay * self.w) / (h + self.decay)


def _small_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A dense logistic model by Newton steps with a light ridge; for calibration and combination."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-1 * w)
    return w


class CoTrained:
    """Both views' models of one label, their calibration and combination, as plain arrays."""

    def __init__(self, texts: list[bytes], pages: list[bytes], y: np.ndarray, held: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5
        self.usable = len(set(y[~held])) == 2 and len(set(y[held])) == 2
        self.history: list[tuple[float, float]] = []
        if not self.usable:
            return
        pick = lambda xs, mask: _rows(x for x, m in zip(xs, mask, strict=True) if m)
        self.known, self.held = [pick(v, ~held) for v in (texts, pages)], [pick(v, held) for v in (texts, pages)]
        self.y, self.y_held = y[~held], y[held]
        self.models = [Logistic(d, n).fit(x, self.y) for d, n, x in zip((TEXT_DIMS, PAGE_DIMS), (SHAPES, 0), self.known, strict=True)]

    def learn(self, g: np.ndarray, h: np.ndarray) -> None:
        """One step of both views on the labelled documents and, by their sums g and h (class, dimension), on the taught ones."""
        for k, (model, x, at) in enumerate(zip(self.models, self.known, (0, TEXT_DIMS), strict=True)):
            own = slice(at, at + len(model.w))
            taught = g[:, DIMS - 2 + k]
            total_g, total_h = np.zeros_like(model.w), np.zeros_like(model.w)
            for c in (0, 1):
                mine = self.y == c
                gc, hc = model.slopes(x, c, mine)
                total_g, total_h = total_g + gc * 0.5 / mine.sum(), total_h + hc * 0.5 / mine.sum()
                if taught.min() > 0:
                    total_g, total_h = total_g + g[c, own] * 0.5 / taught[c], total_h + h[c, own] * 0.5 / taught[c]
            model.move(total_g, total_h)

    def note(self) -> None:
        """Adds to `history` the views' shares of right calls on held documents."""
        self.history.append(tuple(float(((m.margins(x) > 0) == (self.y_held > 0.5)).mean()) for m, x in zip(self.models, self.held, strict=True)))

    def settle(self) -> None:
        margins = [m.margins(x) for m, x in zip(self.models, self.held, strict=True)]
        self.scales = [_small_fit(m[:, None], self.y_held) for m in margins]
        self.mix = _small_fit(np.column_stack([a + b * m for (a, b), m in zip(self.scales, margins, strict=True)]), self.y_held)
        del self.known, self.held

    def score(self, views: list[tuple]) -> list[np.ndarray]:
        """The combined probabilities of documents and those of the views alone."""
        if not self.usable:
            n = len(np.unique(views[1][1]))
            return [np.full(n, self.share)] * 3
        z = [a + b * m.margins(x) for (a, b), m, x in zip(self.scales, self.models, views, strict=True)]
        return [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (self.mix[0] + self.mix[1] * z[0] + self.mix[2] * z[1], *z)]


def add_slopes(teachers: list, learners: list, views: list[tuple], g: np.ndarray, h: np.ndarray) -> None:
    """Adds to g and h (label, class, dimension) the sums of documents that one view is sure of, for the other to learn from."""
    for t, (taught_by, pair) in enumerate(zip(teachers, learners, strict=True)):
        for k, model in enumerate(pair):
            margin, at = taught_by[1 - k].margins(views[1 - k]), (0, TEXT_DIMS)[k]
            for c in (0, 1):
                use = margin > SURE if c else margin < -SURE
                if use.any():
                    gc, hc = model.slopes(views[k], c, use)
                    g[t, c, at : at + len(gc)] += gc
                    h[t, c, at : at + len(hc)] += hc
                    g[t, c, DIMS - 2 + k] += use.sum()


def _pool_slopes(pool: DataFrame, teachers: list, learners: list) -> tuple[np.ndarray, np.ndarray]:
    """The sums of add_slopes over all of pool. The driver gets one row for each dimension at most."""
    sent = pool.sparkSession.sparkContext.broadcast((teachers, learners))
    shape = (len(learners), 2, DIMS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros(shape), np.zeros(shape)
        for f in frames:
            for at in range(0, len(f), BLOCK):
                some = f.iloc[at : at + BLOCK]
                add_slopes(*sent.value, [_rows(some["text"]), _rows(some["page"])], g, h)
        slots = np.flatnonzero(g.ravel() != 0)
        yield pd.DataFrame({"slot": slots, "g": g.ravel()[slots], "h": h.ravel()[slots]})

    sums = pool.select("text", "page").mapInPandas(run, "slot bigint, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    g, h = np.zeros(shape), np.zeros(shape)
    at = sums["slot"].to_numpy()
    g.ravel()[at], h.ravel()[at] = sums["g"].to_numpy(), sums["h"].to_numpy()
    sent.destroy()
    return g, h


def views(docs: DataFrame, labels: DataFrame, targets: list[str], id_col: str, text_col: str, lang_col: str, source_col: str, length_col: str) -> DataFrame:
    """Per document, stored: i, text and page (its active dimensions), known (whether it's in the labelled sample), y0, y1, ... (its labels)."""

    def run(lang: pd.Series, source: pd.Series, length: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "text": [text_view(t, _SEEN).tobytes() for t in text],
            "page": [page_view(a, b, c).tobytes() for a, b, c in zip(lang, source, length, strict=True)],
        })

    marks = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("i")).agg(*[F.min(f"`{t}`").cast("double").alias(f"y{k}") for k, t in enumerate(targets)])
    chosen = stored(marks.orderBy(F.xxhash64("i"), "i").limit(LABELLED).withColumn("known", F.lit(True)), "labelled")
    kind = StructType([StructField("text", BinaryType()), StructField("page", BinaryType())])
    both = F.pandas_udf(run, kind)(F.col(f"`{lang_col}`").cast("string"), F.col(f"`{source_col}`").cast("string"), F.col(f"`{length_col}`").cast("double"), F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), both.alias("_v")).select("i", "_v.text", "_v.page")
    return stored(rows.join(F.broadcast(chosen), "i", "left"), "views")  # LABELLED rows at most are broadcast


def fit(rows: DataFrame, targets: int) -> list[CoTrained]:
    """One model for each label, from all of `rows`, which are what views() gives."""
    ys = [f"y{k}" for k in range(targets)]
    known = stored(rows.where("known").groupBy("i").agg(F.min(F.struct("text", "page", *ys)).alias("v")).select("i", "v.*"), "known")
    upto = F.sum(F.octet_length("text") + F.octet_length("page")).over(Window.orderBy(F.xxhash64("i"), "i"))  # LABELLED rows at most
    fits = known.select("i", upto.alias("bytes")).where(F.col("bytes") <= LABELLED_BYTES)
    sample = sorted(known.join(F.broadcast(fits), "i").collect(), key=lambda r: r["i"])
    out = []
    for y in ys:
        own = [r for r in sample if r[y] is not None and r[y] == r[y]]
        held = np.array([zlib.crc32(str(r["i"]).encode()) % 4 == 0 for r in own], bool)
        out.append(CoTrained([r["text"] for r in own], [r["page"] for r in own], np.array([r[y] for r in own], float), held))
    live, pool = [m for m in out if m.usable], rows.where("known IS NULL")
    for _ in range(ROUNDS if live else 0):
        teachers = [copy.deepcopy(m.models) for m in live]
        for m in live:
            m.note()
        for _ in range(STEPS):
            g, h = _pool_slopes(pool, teachers, [m.models for m in live])
            for k, m in enumerate(live):
                m.learn(g[k], h[k])
    for m in live:
        m.note()
        m.settle()
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """Per document: id, quality_score and toxic_score (probabilities), text_score and page_score (quality by one view), keep."""
    rows = views(docs, labels, ["quality", "toxic"], id_col, text_col, lang_col, source_col, length_col)
    models = docs.sparkSession.sparkContext.broadcast(fit(rows, 2))
    kind = StructType([StructField(n, DoubleType()) for n in ("quality", "toxic", "text", "page")])

    def run(text: pd.Series, page: pd.Series) -> pd.DataFrame:
        quality, toxic = models.value
        out = [np.zeros((0, 4))]
        for at in range(0, len(text), BLOCK):
            v = [_rows(text.iloc[at : at + BLOCK]), _rows(page.iloc[at : at + BLOCK])]
            q = quality.score(v)
            out.append(np.column_stack([q[0], toxic.score(v)[0], q[1], q[2]]))
        return pd.DataFrame(np.concatenate(out), columns=["quality", "toxic", "text", "page"])

    out = rows.select(F.col("i").alias(id_col), F.pandas_udf(run, kind)("text", "page").alias("_m"))
    return out.select(
        id_col, F.col("_m.quality").alias("quality_score"), F.col("_m.toxic").alias("toxic_score"), F.col("_m.text").alias("text_score"), F.col("_m.page").alias("page_score"),
        ((F.col("_m.quality") >= KEEP) & (F.col("_m.toxic") < KEEP)).alias("keep"),
    )


_SEEN: dict[bytes, list[int]] = {}
