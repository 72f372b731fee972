"""Toxicity of whole texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features say how much of a text is made of words and word beginnings that toxic texts of the labelled sample hold
(lexicon densities, at several strengths), how near such words stand to words for the reader (second-person proximity),
and how it is written: capitals, marks, signs inside of words (obfuscation), repetition, length. Words are read as
they stand and with look-alike signs undone ("1d!0t"), so that a disguised word of the lexicon counts.

The lexicon: every beginning of LEAD_LEAST to LEAD_MOST letters of a word and every whole word, weighed by the lower
bound of its log odds between toxic and other documents (presence per document); those over WEIGHT that stand in ENOUGH toxic
documents are kept, MOST at most. Invented and inflected forms are caught by their beginning.

Learning takes a bounded sample, LABELLED documents (the first by a hash of the id) among those labelled whose
crc32(id) mod 4 is not 2; tasks give their word beginnings and features, never texts, to the driver. The features of a sample document come
from a lexicon learned without its fold, so that trees don't trust the lexicon more than it deserves on new
texts; the trees' raw scores for calibration come from models of the other folds, too. Scoring visits every document
once, whatever its label, and reads its text and nothing else.

Defined cases: null and empty texts score as texts without words; very long texts are read whole; null labels and labels
without documents are ignored, the greatest of several counts; without two classes in the sample each document scores the share of
toxic ones (0 without labels); repeated rows repeat; a null id is not held out; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Documents of the labelled sample; bytes of text beyond which a sample document is left to others (none is cut); entries of the lexicon.
LABELLED, LONGEST, MOST = 20_000, 1 << 20, 5_000
#: Letters of a beginning; least weight of an entry; toxic documents it must stand in.
LEAD_LEAST, LEAD_MOST, WEIGHT, ENOUGH = 4, 9, 0.7, 4
FOLDS, CUTOFF = 4, 0.3
#: The trees: number, depth, step, bins of a feature, ridge, least curvature of a leaf.
TREES, DEPTH, STEP, BINS, RIDGE, LEAF = 120, 4, 0.12, 48, 1.0, 2.0
#: Words for the reader in the languages of the corpus.
YOU = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deiner deinem deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vos os vuestro".split())
#: Signs that stand for letters.
LOOKS = str.maketrans("013457@$!|€", "oieastasiie")
#: Steps of the lexicon's weights at which densities are taken; words between a hit and a word for the reader.
TIERS, NEAR = (0.7, 1.5, 2.5, 3.5, 5.0), 6
_TOKEN, _RUNS = re.compile(r"\S+"), re.compile(rb"[!?]{2,}")
#: Kinds of bytes: 1 capitals, 2 digits, 3 signs, 4 other marks, 5 other letters (and all beyond ASCII).
_KINDS = bytes(1 if 65 <= i < 91 else 2 if 48 <= i < 58 else 3 if i in b"#*$%&|<>@" else 0 if i <= 32 or i == 127 else 5 if i >= 128 or 97 <= i < 123 else 4 for i in range(256))
_TRIM = "\"'`.,;:!?()[]{}<>*_~#%&+-=/\\|^“”„‘’«»¡¿…–—"
_KEPT = 300_000  # words that a worker remembers

FEATURES = [
    *[f"hits_{t}" for t in TIERS], *[f"density_{t}" for t in TIERS], "strongest", "second", "third", "weight_sum", "weight_mean", "different", "disguised_hits", "near_you", "near_you_share", "you_rate",
    "capital_share", "shouted_share", "marks_rate", "calls_rate", "asks_rate", "runs_of_marks", "disguised_rate", "digits_rate", "signs_rate", "repeat_share", "own_share", "log_words", "word_length",
]


def forms(token: str) -> tuple[str, str, bool]:
    """A token's word in lower case, the word with look-alike signs undone, and whether signs or digits stand among its letters."""
    word = token.strip(_TRIM).lower()
    if word.isalpha() or not word:
        return word, word, False
    mixed = any(c.isalpha() for c in word)
    plain = "".join(c for c in token.strip("\"'`.,;:?()[]{}<>“”„‘’«»").lower().translate(LOOKS) if c.isalpha()) if mixed else word
    return word, plain, mixed and not all(c.isalpha() or c in "-'’" for c in word)


def leads(word: str) -> Iterator[str]:
    """What the lexicon may know a word by: its beginnings, and itself."""
    for k in range(LEAD_LEAST, min(LEAD_MOST, len(word)) + 1):
        yield word[:k]
    if word:
        yield word + "$"


def entries(text: str | None) -> set[str]:
    """All leads of a text's words, each once."""
    words = {w for t in _TOKEN.findall(text or "") for w in forms(t)[:2]}
    return {x for w in words for x in leads(w)}


class Reader(dict):
    """Turns texts into features by one lexicon; remembers tokens."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.heads = lexicon, {x[:LEAD_LEAST] for x in lexicon}

    def _best(self, word: str) -> float:
        if f"{word}$"[:LEAD_LEAST] not in self.heads:  # no lead of the word begins like an entry
            return 0.0
        return max((self.lexicon.get(x, 0.0) for x in leads(word)), default=0.0)

    def __missing__(self, token: str) -> tuple[str, float, float, bool, bool, bool]:
        """Of a token: its word, its weight, that of its undisguised form where it differs, whether it is disguised, means the reader, is shouted."""
        word, plain, mixed = forms(token)
        hidden = self._best(plain) if plain != word else 0.0
        found = self[token] = (word, max(self._best(word), hidden), hidden, mixed, word in YOU, len(token) > 2 and token.isupper())
        return found

    def features(self, text: str | None) -> list[float]:
        if len(self) > _KEPT:
            self.clear()
        text = text or ""
        tokens = _TOKEN.findall(text)
        known = [(self[t], n) for t, n in Counter(tokens).items()]  # what order doesn't matter to is read once a token
        n, size = max(1, len(tokens)), max(1, len(text))
        hits = [(r, c) for r, c in known if r[1] > 0]
        best = {r[0]: r[1] for r, _ in hits}
        top = sorted(best.values(), reverse=True)[:3] + [0.0] * 3
        yours = sum(c for r, c in known if r[4])
        strong = {t for t in tokens if self[t][1] >= TIERS[1]} if top[0] >= TIERS[1] else ()
        near, strongly = 0, 0
        if strong:
            at = np.array([i for i, t in enumerate(tokens) if t in strong], np.int64)
            strongly = len(at)
            if yours:
                at_you = np.array([i for i, t in enumerate(tokens) if self[t][4]], np.int64)
                spot = np.searchsorted(at_you, at)
                gap = np.minimum(np.abs(at - at_you[np.maximum(spot - 1, 0)]), np.abs(at_you[np.minimum(spot, yours - 1)] - at))
                near = int((gap <= NEAR).sum())
        over = [sum(c for r, c in hits if r[1] >= t) for t in TIERS]
        raw = text.encode("utf-8", "replace")
        kinds = raw.translate(_KINDS)
        upper, digits, signs, marks, letters = (kinds.count(k) for k in range(1, 6))
        calls, asks = raw.count(b"!"), raw.count(b"?")
        return [
            *over, *[x / n for x in over], top[0], top[1], top[2], sum(best.values()), sum(r[1] * c for r, c in hits) / n, len(best), sum(c for r, c in hits if r[2] > 0), near, near / max(1, strongly), yours / n,
            upper / max(1, upper + letters), sum(c for r, c in known if r[5]) / n, (marks + signs) / size, calls / n, asks / n, len(_RUNS.findall(raw)) / n if calls + asks > 1 else 0.0, sum(c for r, c in known if r[3]) / n,
            digits / size, signs / size, sum(map(eq, tokens, tokens[1:])) / n, len({r[0] for r, _ in known}) / n, float(np.log1p(len(tokens))), sum(len(r[0]) * c for r, c in known) / n,
        ]


def learn_lexicon(lead: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> dict[str, float]:
    """Leads by the lower bound of their log odds, the MOST best; toxic and other: documents that hold each."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    bound = odds - np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)) * (other > 0) - np.sqrt(1 / (toxic + 0.5)) * (other == 0)
    good = np.flatnonzero((toxic >= ENOUGH) & (bound > WEIGHT))
    good = good[np.lexsort((lead[good], -(bound * np.sqrt(toxic))[good]))][:MOST]
    return {str(lead[i]): float(bound[i]) for i in good}


class Boosted:
    """Gradient-boosted trees of one depth for the logistic loss, over binned features: each level asks one question of every node."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        bins = self.binned(x)
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(bins, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += self._leaf(tree, bins)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)]).astype(np.int64) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, width = 2**DEPTH - 1, bins.shape[1]
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(2 * nodes + 1)
        node = np.zeros(len(bins), np.int64)
        for level in range(DEPTH):
            first, here = 2**level - 1, 2**level
            slot = node - first
            live = slot >= 0
            shape = (here, width, BINS)
            flat = ((slot[live, None] * width + np.arange(width)) * BINS + bins[live]).ravel()
            sums = [np.bincount(flat, np.repeat(v[live], width), here * width * BINS).reshape(shape) for v in (g, h)]
            left, total = [s.cumsum(2) for s in sums], [s[:, :1].sum(2, keepdims=True) for s in sums]
            right = [t - a for t, a in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
            gain[(left[1] < LEAF) | (right[1] < LEAF)] = 0
            best = gain.reshape(here, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(here, -1).max(1) > 1e-6):
                feature[first + k], cut[first + k] = best[k] // BINS, best[k] % BINS
            split = live & (feature[np.where(live, node, 0)] >= 0)
            at = np.flatnonzero(split)
            node[at] = 2 * node[at] + 1 + (bins[at, feature[node[at]]] > cut[node[at]])
            node[live & ~split] -= 10 * nodes  # a leaf; its number is put right below
        node = np.where(node < 0, node + 10 * nodes, node)
        weight = [np.bincount(node, v, len(value)) for v in (g, h)]
        value = -STEP * weight[0] / (weight[1] + RIDGE)
        return feature, cut, value

    @staticmethod
    def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            at = np.minimum(node, len(feature) - 1)
            on = (node < len(feature)) & (feature[at] >= 0)
            node = np.where(on, 2 * node + 1 + (bins[rows, np.maximum(feature[at], 0)] > cut[at]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return self.start + sum(self._leaf(t, bins) for t in self.trees) if len(x) else np.zeros(0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function of raw that is nearest to y, by pooling neighbours that fall."""
    at, inverse = np.unique(raw, return_inverse=True)
    pools: list[list[float]] = []  # mean, weight, first, last
    for i, (s, n) in enumerate(zip(np.bincount(inverse, y), np.bincount(inverse), strict=True)):
        pools.append([s / n, n, at[i], at[i]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (m, w, a, _), (m2, w2, _, b) = pools[-2:]
            pools[-2:] = [[(m * w + m2 * w2) / (w + w2), w + w2, a, b]]
    xs, ps = [x for _, _, a, b in pools for x in (a, b)], [m for m, *_ in pools for _ in (0, 1)]
    return np.array(xs), np.array(ps)


class Model:
    """Lexicon, trees and calibration; or a share where there is nothing to learn from."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, self.share, self.trees = lexicon, float(y.mean()) if len(y) else 0.0, None
        if len(set(y)) < 2:
            return
        self.trees = Boosted(x, y)
        held = np.full(len(y), self.trees.start)
        for f in range(FOLDS):
            if len(set(y[fold != f])) == 2:
                held[fold == f] = Boosted(x[fold != f], y[fold != f]).raw(x[fold == f])
        self.knots = isotonic(held, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a little of the raw score's own order is kept within a pool, so that equal pools still rank."""
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(i: Column) -> Column:
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """docs and labels as they are; learns from labelled documents that aren't held out."""
    marks = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("i")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("y"))
    marks = marks.where(~held_out(F.col("i"))).orderBy(F.xxhash64("i"), "i").limit(LABELLED)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sample = docs.select(F.col(f"`{id_col}`").alias("i"), text.alias("text")).where(F.octet_length("text") <= LONGEST).join(F.broadcast(stored(marks, "labelled")), "i")  # LABELLED rows at most are broadcast
    sample = stored(sample.groupBy("i", "y").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(FOLDS)).cast("int")), "sample")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for fold, y, text in zip(f["fold"], f["y"], f["text"], strict=True):
                found = np.array(sorted(entries(text)), object)
                yield pd.DataFrame({"lead": found, "slot": np.full(len(found), 2 * fold + int(y > 0))})

    per_slot = [F.count_if(F.col("slot") == s).alias(f"n{s}") for s in range(2 * FOLDS)]
    toxic = sum(F.col(f"n{2 * f + 1}") for f in range(FOLDS))
    other = sum(F.col(f"n{2 * f}") for f in range(FOLDS))
    # Most leads stand in few toxic documents; of the rest the driver takes those that lean most to them.
    found = sample.mapInPandas(run, "lead string, slot int").groupBy("lead").agg(*per_slot).where(toxic >= ENOUGH).withColumn("lean", F.log((toxic + 0.5) / (other + 0.5))).orderBy(F.desc("lean"), "lead").limit(10 * MOST).toPandas()
    counted = found[[f"n{s}" for s in range(2 * FOLDS)]].to_numpy(np.float64).reshape(len(found), FOLDS, 2)
    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", (F.col("y") > 0).cast("int").alias("y")).count().collect():
        sizes[r["fold"], r["y"]] = r["count"]
    lead = found["lead"].to_numpy(object)

    def lexicon(folds: list[int]) -> dict[str, float]:
        n, s = counted[:, folds].sum(1), sizes[folds].sum(0)
        return learn_lexicon(lead, n[:, 1], n[:, 0], s[1], s[0])

    apart = sample.sparkSession.sparkContext.broadcast([lexicon([g for g in range(FOLDS) if g != f]) for f in range(FOLDS)])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [Reader(x) for x in apart.value]
        for f in frames:
            yield pd.DataFrame({"i": f["i"].astype(str).astype(object), "y": f["y"], "fold": f["fold"], "x": [readers[g].features(t) for g, t in zip(f["fold"], f["text"], strict=True)]})

    rows = sample.mapInPandas(read, "i string, y int, fold int, x array<double>").toPandas().sort_values("i", kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    return Model(lexicon(list(range(FOLDS))), x, (rows["y"].to_numpy() > 0).astype(float), rows["fold"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model.value.lexicon)
        for some in texts:
            x = np.array([reader.features(t) for t in some], np.float64).reshape(len(some), len(FEATURES))
            yield pd.Series(model.value.score(x), dtype="float64")

    i = F.col(f"`{id_col}`")
    out = docs.select(i.alias(id_col), held_out(i).alias("held_out"), scored(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
