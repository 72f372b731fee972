"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word unigram base.

Counting covers every training document: words are counted in the workers and summed by a shuffle, subword
ids likewise. Subwords come from a public byte-level BPE vocabulary (a parameter), applied to each word with
its space, to every different word of a run of texts once; one pass writes every text's ids, and training and scoring read those alone. The model predicts
classes of subwords: the most frequent ones are classes of their own, the others share bins by frequency and
by whether they begin a word; a subword's probability is its class's times its smoothed share of that class.
A class is found in two steps, a group and a member of it. All subwords have some, so the whole is a
distribution.

The attention model (one causal layer with a feed-forward block) learns from every position of every
training document, in windows that don't overlap. Texts are dealt to ROUNDS rounds and to shards by a hash of their ids, the copies of
one text evenly over all shards; there is a shard for each SHARD subwords of the corpus, so that a replica never learns from little. In
a round each shard trains a replica on its own windows in an order by hash, and the replicas are averaged, weighted by their
windows, in a tree of sums. A corpus of fewer than LEARNED subwords goes through all rounds again until as many positions were
learned from. So weights hang on the texts alone, not on how the table lies in files or partitions. Scoring cuts each text's ids into overlapping windows of CONTEXT inputs, of which the last
STRIDE are predicted, so every token is scored once with at least CONTEXT - STRIDE before it (as far as
there are any); windows are batched over documents and masked.

For the base, words frequent enough that at most TOP_WORDS are that frequent are looked up in the workers;
the others go through a shuffled join with the full counts. This changes no result, only the way.

Defined cases: null and empty texts are one end token; null ids count as the empty text in the hold-out
rule; repeated rows repeat; an empty table gives an empty result; without training documents the classes
are uniform; texts of any length are read in pieces of bounded size; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .token_ids import Tokenizer, tokenizer, vocabulary

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CONTEXT, STRIDE, WIDTH, HIDDEN, GROUPS, MEMBERS, BINS = 32, 28, 16, 16, 32, 32, 64
CLASSES, LAST = GROUPS * MEMBERS, WIDTH - 1
ROUNDS, BATCHES, POOL, RATE, SEED, FAN = 3, (128, 256, 256), 4096, 0.012, 11, 16
SHARD, LEARNED, MOST_EPOCHS = 8_000_000, 12_000_000, 20
SCORED, PIECE, SLICE, COUNTED = 512, 4096, 16 << 20, 1 << 20
TOP_WORDS, LN10 = 200_000, float(np.log(10))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in runs of SLICE bytes at most, or of one text, each with its first row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, and where each text's begin (and the last one's end). Where white space begins or ends a text stands an empty one."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    return lists.flatten(), lists.offsets.to_numpy()


# ---- counting


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            seen = pc.value_counts(words_of(texts)[0])
            seen = seen.filter(pc.not_equal(pc.binary_length(seen.field(0)), 0))
            yield pa.RecordBatch.from_arrays([seen.field(0), seen.field(1)], names=["word", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """training: (text). (word, n) over all of it, stored."""
    return stored(training.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")


def joined(ids: pa.Array) -> np.ndarray:
    """The subword ids of all texts of a column, one after the other, as they lie there."""
    _, offsets, data = ids.buffers()
    begin, end = np.frombuffer(offsets, np.int32)[[ids.offset, ids.offset + len(ids)]] if len(ids) else (0, 0)
    return np.frombuffer(data, np.uint16, (end - begin) // 2, begin) if end > begin else np.zeros(0, np.uint16)


def subword_counts(encoded: DataFrame) -> np.ndarray:
    """encoded: (ids). How often each subword id occurs; summed by a shuffle, one row an id on the driver."""

    def run(batches):
        sums = np.zeros(1 << 16, np.int64)
        for batch in batches:
            own = joined(batch.column(0))
            for at in range(0, len(own), COUNTED):
                sums += np.bincount(own[at : at + COUNTED], minlength=1 << 16)
        some = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], names=["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in encoded.mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def classes(counts: np.ndarray, initial: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each subword its class and the log10 of its share of it; and the classes' counts. Class 0 is the end of a text.

    initial: which ids begin a word (and exist: others of the table are never met)."""
    order = np.argsort(-counts, kind="stable")
    kind, share = np.zeros(len(counts), np.int16), np.zeros(len(counts))
    own = CLASSES - 1 - BINS
    kind[order[:own]] = 1 + np.arange(own)
    rest = order[own:]
    for b, first in ((0, True), (BINS // 2, False)):
        part = rest[initial[rest] == first]
        mass = np.cumsum(counts[part] + 0.5)
        bins = np.minimum((mass / max(mass[-1], 1e-9) * (BINS // 2)).astype(int), BINS // 2 - 1) if len(part) else mass.astype(int)
        kind[part] = 1 + own + b + bins
        for i in range(BINS // 2):
            members = part[bins == i]
            if len(members):
                share[members] = np.log10((counts[members] + 0.5) / (counts[members] + 0.5).sum())
    sums = np.bincount(kind, counts + 0.0, CLASSES)
    sums[0] = ends
    return kind, share, sums


# ---- the model


def initial_weights(class_counts: np.ndarray) -> dict[str, np.ndarray]:
    """The last channel of all states is the constant one: it carries the biases, and the sums of attention."""
    rng = np.random.default_rng(SEED)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    some = class_counts + 0.5
    groups = some.reshape(GROUPS, MEMBERS)
    d, h = WIDTH, HIDDEN
    w = {"e": draw(CLASSES, d, scale=0.3), "p": draw(CONTEXT, d, scale=0.1), "a": draw(d, d, scale=0.1), "o": draw(d, d, scale=0.25), "f": draw(d, h, scale=0.25), "g": draw(h, d, scale=0.15), "u": draw(d, GROUPS, scale=0.15), "m": draw(GROUPS, d, MEMBERS, scale=0.15)}
    w["e"][:, LAST] = 1
    for k in "pog":
        w[k][:, LAST] = 0
    w["u"][LAST] = np.log(groups.sum(axis=1) / some.sum())
    w["m"][:, LAST] = np.log(groups / groups.sum(axis=1, keepdims=True))
    return w


_CAUSAL = np.tri(CONTEXT, dtype=np.float32)
_GROUPS, _MEMBERS = np.ones(GROUPS, np.float32), np.ones(MEMBERS, np.float32)


def padding(ids: np.ndarray) -> np.ndarray | None:
    """Where windows hold padding, if any does; it stands at their ends."""
    return ids < 0 if (ids[:, 0] < 0).any() or (ids[:, -1] < 0).any() else None


def _exp(x: np.ndarray) -> np.ndarray:
    """e^x within 4 %, of float32: powers of two with straight lines between whole exponents, made by writing x into a float's bits.

    It is positive and rises with x, and softmaxes divide by its own sums, so what comes of it is a distribution as
    ever; np.exp takes several times as long, and is half of the model's time."""
    np.clip(x, -60, 60, out=x)
    x *= float((1 << 23) / np.log(2))  # numpy's own number of doubles would have every product made in doubles
    x += 127 * (1 << 23) - 486_411  # the least mean square error
    return x.astype(np.int32).view(np.float32)


def forward(w: dict, ids: np.ndarray, stride: int = STRIDE):
    """What the model holds at the last stride positions of windows ids (n, CONTEXT), and what `gradients` needs; -1 is padding, which nothing attends to."""
    n, d = len(ids), WIDTH
    x = w["e"].take(ids, 0, mode="wrap")
    x += w["p"]
    if (pad := padding(ids)) is not None:
        x[pad] = 0
    y = x[:, CONTEXT - stride :].reshape(-1, d)
    q = y @ w["a"]
    s = _exp(np.matmul(q.reshape(n, stride, d), x.transpose(0, 2, 1)))
    s *= _CAUSAL[CONTEXT - stride :]
    u = np.matmul(s, x).reshape(-1, d)
    sums = np.maximum(u[:, LAST:], 1e-30)
    u /= sums
    r = u @ w["o"]
    r += y
    f = r @ w["f"]
    np.clip(f, 0, 1e30, out=f)
    z = f @ w["g"]
    z += r
    return z, (x, y, q, s, sums, u, r, f)


def _members(w: dict, z: np.ndarray, t: np.ndarray):
    """Places of targets t in order of their groups (those of no target apart), groups, members, cuts between groups, and the members' logits there.

    A class is a group and a member of it, each a softmax, so that a token costs GROUPS + MEMBERS exponentials."""
    order = np.argsort(t, kind="stable")
    ts = t[order]
    first = int(np.searchsorted(ts, 0))
    none, order, ts = order[:first], order[first:], ts[first:]
    cuts = np.searchsorted(ts, np.arange(GROUPS + 1) * MEMBERS).tolist()
    held, logits = z.take(order, 0), np.empty((len(ts), MEMBERS), np.float32)
    for g in range(GROUPS):
        if cuts[g] < cuts[g + 1]:
            np.matmul(held[cuts[g] : cuts[g + 1]], w["m"][g], out=logits[cuts[g] : cuts[g + 1]])
    group = ts // MEMBERS
    return none, order, group, ts - group * MEMBERS, cuts, held, logits


def log_probabilities(w: dict, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of targets (n, stride); 0 where the target is -1."""
    z, _ = forward(w, ids, targets.shape[1])
    t = targets.reshape(-1)
    groups = _exp(z @ w["u"])
    _, order, group, member, _, _, members = _members(w, z, t)
    members = _exp(members)
    p = groups.ravel().take(order * GROUPS + group) / np.maximum(groups @ _GROUPS, 1e-30).take(order)
    p *= members.ravel().take(np.arange(len(order)) * MEMBERS + member) / np.maximum(members @ _MEMBERS, 1e-30)
    out = np.zeros(len(t), np.float32)
    out[order] = np.log(np.maximum(p, 1e-37))
    return out.reshape(targets.shape)


def gradients(w: dict, ids: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the targets that aren't -1; for "e" the rows met and their gradients."""
    stride = targets.shape[1]
    z, (x, y, q, s, sums, u, r, f) = forward(w, ids, stride)
    n, d, t = len(ids), WIDTH, targets.reshape(-1)
    groups = _exp(z @ w["u"])
    none, order, group, member, cuts, held, members = _members(w, z, t)
    scale = np.float32(1 / max(1, len(order)))
    share = scale / np.maximum(groups @ _GROUPS, 1e-30)
    share[none] = 0
    groups *= share[:, None]
    groups.ravel()[order * GROUPS + group] -= scale
    members = _exp(members)
    members *= (scale / np.maximum(members @ _MEMBERS, 1e-30))[:, None]
    members.ravel()[np.arange(len(order)) * MEMBERS + member] -= scale
    g = {"u": z.T @ groups, "m": np.zeros_like(w["m"])}
    dz, dheld = groups @ w["u"].T, np.empty((len(held) + 1, d), held.dtype)
    dheld[-1] = 0  # of places without target
    for i in range(GROUPS):
        a, b = cuts[i], cuts[i + 1]
        if a < b:
            np.matmul(held[a:b].T, members[a:b], out=g["m"][i])
            np.matmul(members[a:b], w["m"][i].T, out=dheld[a:b])
    place = np.full(len(t), len(held))
    place[order] = np.arange(len(held))
    dz += dheld.take(place, 0)
    dz[:, LAST] = 0
    g["g"] = f.T @ dz
    df = dz @ w["g"].T
    df *= f > 0
    g["f"] = r.T @ df
    dr = df @ w["f"].T
    dr += dz
    g["o"] = u.T @ dr
    du = dr @ w["o"].T
    du[:, LAST] = 0
    np.negative(np.einsum("ij,ij->i", du, u), out=du[:, LAST])
    du /= sums
    du = du.reshape(n, stride, d)
    ds = np.matmul(du, x.transpose(0, 2, 1))
    ds *= s
    dx = np.matmul(s.transpose(0, 2, 1), du)
    dx += np.matmul(ds.transpose(0, 2, 1), q.reshape(n, stride, d))
    dq = np.matmul(ds, x).reshape(-1, d)
    g["a"] = y.T @ dq
    dy = dq @ w["a"].T
    dy += dr
    dx[:, CONTEXT - stride :] += dy.reshape(n, stride, d)
    if (pad := padding(ids)) is not None:
        dx[pad] = 0
    g["p"] = dx.sum(axis=0)
    flat = ids.reshape(-1)
    real = np.argsort(flat, kind="stable")
    sorted_ = flat[real]
    first = int(np.searchsorted(sorted_, 0))
    real, sorted_ = real[first:], sorted_[first:]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(real) else np.zeros(0, int)
    pairs = np.result_type(dx.dtype, np.complex64)  # two channels are summed up at a time
    rows = np.add.reduceat(dx.reshape(-1, d).take(real, 0).view(pairs), starts, axis=0).view(dx.dtype) if len(real) else np.zeros((0, d), np.float32)
    for x in (rows, g["p"], g["o"], g["g"]):  # the constant channel stays one
        x[:, LAST] = 0
    g["e"] = (sorted_[starts], rows)
    return g


class Adam:
    def __init__(self, w: dict, rate: float = RATE):
        self.w, self.rate, self.t = w, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        a, b = 1 - 0.9**self.t, math.sqrt(1 - 0.99**self.t)
        rate, least = np.float32(self.rate * min(1.0, self.t / 10) * b / a), np.float32(1e-8 * b)
        for k, x in self.w.items():
            m, v, some = self.m[k], self.v[k], g[k]
            if k == "e":  # rows that weren't met stand still
                rows, some = some
                whole, (x, m, v) = (x, m, v), (x[rows], m[rows], v[rows])
            by = some - m
            by *= np.float32(0.1)
            m += by
            np.multiply(some, some, out=by)
            by -= v
            by *= np.float32(0.01)
            v += by
            np.sqrt(v, out=by)
            by += least
            np.divide(m, by, out=by)
            by *= rate
            x -= by
            if k == "e":
                for to, values in zip(whole, (x, m, v), strict=True):
                    to[rows] = values


# ---- windows


def subwords(words: pa.Array, encode, first: np.ndarray) -> pa.Array:
    """Of each word its subword ids, as bytes; none of an empty one. All in one go: no piece reaches over a space, and each word's first piece alone begins with one."""
    some = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    sizes, ids = np.zeros(len(words) + 1, np.int64), np.zeros(0, np.uint16)
    if n := int(some.sum()):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words.filter(pa.array(some)).view(pa.binary())), b" ")[0]
        ids = np.array(encode(" " + joined.as_py().decode("utf-8", "replace")), np.uint16)
        starts = np.flatnonzero(first[ids])
        if len(starts) != n:
            raise ValueError(f"{n} words gave {len(starts)} beginnings")
        sizes[1:][some] = 2 * np.diff(starts, append=len(ids))
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.cumsum(sizes).astype(np.int32)), pa.py_buffer(ids)])


def initial(encoding) -> np.ndarray:
    """Which ids begin a word."""
    return np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(encoding.n_vocab)])


def strip(ids: np.ndarray, first: int, last: int, stride: int) -> np.ndarray:
    """The stretch of a text's class ids, the end token included, that windows first..last - 1 lie on; -1 is padding.

    A window's inputs begin stride after those of the one before it, its targets CONTEXT - stride + 1 after its inputs."""
    out = np.full((last - first) * stride + CONTEXT - stride + 1, -1, np.int16)
    start = first * stride + stride - CONTEXT - 1  # of the first window's inputs, each of which stands before its target
    some = ids[max(start, 0) : start + len(out)]
    out[max(-start, 0) : max(-start, 0) + len(some)] = some
    if start < 0:
        out[-1 - start] = 0
    return out


def on_strips(strips: list[np.ndarray], stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets that begin at every place of strips laid end to end, the places where windows do, and which of these is each strip's first. Only what is taken of the two is copied."""
    whole, back = np.concatenate(strips), CONTEXT - stride + 1
    sizes = np.array([len(s) for s in strips])
    counts = (sizes - back) // stride
    firsts, begins = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    at = np.repeat(begins - stride * firsts, counts) + stride * np.arange(counts.sum())
    step = whole.itemsize
    inputs = np.ndarray((len(whole) - CONTEXT + 1, CONTEXT), whole.dtype, whole, strides=(step, step))
    targets = np.ndarray((len(whole) - back - stride + 1, stride), whole.dtype, whole, back * step, (step, step))
    return inputs, targets, at, firsts


def windows(ids: np.ndarray, first: int, last: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Windows first..last - 1 of a text's class ids, the end token included: inputs (n, CONTEXT) and targets (n, stride)."""
    inputs, targets, at, _ = on_strips([strip(ids, first, last, stride)], stride)
    return inputs[at], targets[at]


def pieces(kind: np.ndarray, ids: np.ndarray, stride: int = STRIDE) -> Iterator[tuple[np.ndarray, int]]:
    """Strips of all windows of a text, given its subword ids, and how many; at most PIECE at a time."""
    own = np.zeros(len(ids) + 1, np.int16)
    own[:-1] = kind.take(ids)
    n = -(-len(own) // stride)
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        yield strip(own, at, to, stride), to - at


# ---- training


def flat(w: dict) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()])


def shaped(values: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, x in like.items():
        out[k] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def _keep_heap() -> None:
    """Arrays of a megabyte are made and dropped at every step: without this, each would be mapped and faulted in anew."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        for option, value in ((-3, 1 << 28), (-1, 1 << 28)):  # the sizes from which memory is mapped, and given back
            libc.mallopt(option, value)


def _replica(values: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for w, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(w.as_buffer(), np.float64)
            total, n = (values.copy() if total is None else total + values), n + k
    if total is not None:
        yield _replica(total, n)


def averaged(replicas: DataFrame, partitions: int) -> tuple[np.ndarray, int] | None:
    """The sum of weights times windows and of windows, added up FAN to one until FAN rows at most reach the driver."""
    while partitions > FAN:
        partitions = -(-partitions // FAN)
        replicas = replicas.repartition(partitions).mapInArrow(_added, "w binary, n bigint")
    rows = replicas.collect()
    return (sum(np.frombuffer(r["w"], np.float64) for r in rows), sum(r["n"] for r in rows)) if rows else None


def dealt(encoded: DataFrame, shards: int) -> DataFrame:
    """encoded: (ids). Every different text with its round, and with its shards and how often each learns from it: (round, shard, at, ids, times), stored."""
    texts = encoded.groupBy("ids").agg(F.count("*").alias("n")).withColumn("at", F.xxhash64("ids", F.lit(SEED)))
    spread = texts.withColumn("k", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(shards)).cast("int") - 1)))
    times = F.floor(F.col("n") / shards) + (F.col("k") < F.col("n") % shards).cast("int")
    shard = F.pmod(F.xxhash64("ids", F.lit(SEED + 1)) + F.col("k"), F.lit(shards)).cast("int")
    return stored(spread.select(F.pmod("at", F.lit(ROUNDS)).cast("int").alias("round"), shard.alias("shard"), "at", "ids", times.cast("int").alias("times")), "dealt")


def train(encoded: DataFrame, weights: dict, kind, subwords: int) -> dict:
    """encoded: (ids), stored, with so many subwords. Every text is learned from in its round, once or, where there are few, equally often."""
    shards, epochs = max(1, subwords // SHARD), max(1, -(-LEARNED // max(1, subwords)) if subwords < LEARNED else 1)
    epochs = min(epochs, MOST_EPOCHS)
    context, rows = encoded.sparkSession.sparkContext, dealt(encoded, shards)
    for step in range(epochs * ROUNDS):
        sent, round_ = context.broadcast(weights), step % ROUNDS
        slower, size = 1 + (ROUNDS - 1) * step / (epochs * ROUNDS - 1), BATCHES[step // epochs]

        def run(batches, sent=sent, slower=slower, size=size):
            _keep_heap()
            for own in _by_shard(batches):
                w = {k: x.copy() for k, x in sent.value.items()}
                adam, held, n, total = Adam(w, RATE / slower), [], 0, 0

                def learn(w=w, adam=adam, held=held):
                    ids, targets, begins, _ = on_strips(held, CONTEXT)
                    mix = begins[np.random.default_rng(total).permutation(len(begins))]
                    for at in range(0, len(mix), size):
                        some = mix[at : at + size]
                        adam.step(gradients(w, ids[some], targets[some]))

                for ids, times in own:
                    for _ in range(times):
                        for piece, count in pieces(kind.value, np.frombuffer(ids, np.uint16), CONTEXT):
                            held.append(piece)
                            n += count
                            if n >= POOL:
                                learn()
                                total, n = total + n, 0
                                held.clear()
                if held:
                    learn()
                    total += n
                if total:
                    yield _replica(flat(w).astype(np.float64) * total, total)

        own = rows.where(F.col("round") == round_).repartition(shards, "shard").sortWithinPartitions("shard", "at", "ids").select("shard", "ids", "times")
        got = averaged(own.mapInArrow(run, "w binary, n bigint"), shards)
        if got:
            weights = shaped(got[0] / got[1], weights)
    return weights


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """(ids, times) of each shard in turn; rows are ordered by shard."""
    rows = ((r, i.as_buffer(), t) for b in batches for r, i, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True))
    for _, own in groupby(rows, key=itemgetter(0)):
        yield ((ids, times) for _, ids, times in own)


# ---- encoding and scoring


def _encoder(ranks, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, end = frequent.value
        encoding, logs = tokenizer(ranks).encoding, np.append(logs, math.nan)
        first = initial(encoding)
        for batch in batches:
            for at, texts in slices(batch.column(batch.num_columns - 1)):
                made = _encoded(texts, encoding.encode_ordinary, first, known, logs, end)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:-1], *made], names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base", "ids", "rare"])

    return run


def _encoded(texts: pa.Array, encode, first: np.ndarray, known: pa.Array, logs: np.ndarray, end: float | None) -> list[pa.Array]:
    """Tokens, known ones, the base of these, subword ids and rare words with their counts of each text. Every different word is looked at once.

    known: words, whose log10 counts are in logs, with nan after the last for words that aren't among them."""
    words, starts = words_of(texts)
    words = words.dictionary_encode()
    own, codes, n = words.dictionary, words.indices.to_numpy(), len(texts)
    row = np.repeat(np.arange(n), np.diff(starts))
    word = pc.not_equal(pc.binary_length(own), 0).to_numpy(zero_copy_only=False)
    log = logs[pc.index_in(own, value_set=known).fill_null(len(known)).to_numpy()]
    rare = np.isnan(log) & word

    def per_text(of_word: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(of_word[codes], dtype=np.int64))
        return sums[starts[1:]] - sums[starts[:-1]]

    n_words, n_rare = per_text(word), per_text(rare)
    base = np.bincount(row, np.where(np.isnan(log), 0.0, log)[codes], n) + (0.0 if end is None else end)
    taken = subwords(own, encode, first).take(words.indices)
    _, offsets, ids = taken.buffers()
    ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.frombuffer(offsets, np.int32, len(codes) + 1)[starts]), ids])
    at = np.flatnonzero(rare[codes])
    pairs, times = np.unique(row[at] * len(own) + codes[at], return_counts=True)
    rows, of = np.divmod(pairs, max(1, len(own)))
    rares = pa.StructArray.from_arrays([own.take(pa.array(of)), pa.array(times, pa.int64())], ["word", "n"])
    ends = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return [pa.array(n_words + 1), pa.array(n_words - n_rare + (end is not None)), pa.array(base), ids, pa.ListArray.from_arrays(ends, rares)]


def _scorer(model, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_heap()
        w, (kind, share) = model.value, table.value
        for batch in batches:
            total, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            held, of = [], []

            def drain():
                x, t, begins, firsts = on_strips(held, STRIDE)
                sums = np.empty(len(begins))
                for at in range(0, len(begins), SCORED):
                    some = begins[at : at + SCORED]
                    log_probabilities(w, x[some], t[some]).sum(axis=1, out=sums[at : at + SCORED])
                np.add.at(total, of, np.add.reduceat(sums, firsts) / LN10)
                held.clear()
                of.clear()

            n = 0
            for row, ids in enumerate(batch.column(batch.num_columns - 1)):
                own = np.frombuffer(ids.as_buffer(), np.uint16)
                sizes[row] = len(own) + 1
                total[row] += share.take(own).sum()
                for piece, count in pieces(kind, own):
                    held.append(piece)
                    of.append(row)
                    n += count
                    if n >= PIECE:
                        drain()
                        n = 0
            if held:
                drain()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total), pa.array(sizes)], names=[*batch.schema.names[:-1], "score", "n_subwords"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    held_out = F.crc32(key.cast("binary")) % 5 == 1
    row = F.monotonically_increasing_id()  # stands still once the ids are stored
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    training = rows.where(~F.col("held_out"))
    ranks = spark.sparkContext.broadcast(vocabulary(path))
    counts = word_counts(training.select("text"))
    ends = training.count()

    # the least frequency class of which at most TOP_WORDS words are as frequent; classes are eighths of octaves
    octave = F.floor(F.log2("n") * 8)
    cut, words = 1 << 30, 0
    sizes = counts.groupBy(octave.alias("o")).agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()
    n, v = sum(r["n"] for r in sizes) + ends, sum(r["count"] for r in sizes) + (ends > 0)
    for r in sorted(sizes, key=lambda r: -r["o"]):
        words += r["count"]
        if words > TOP_WORDS:
            break
        cut = r["o"]
    common = counts.where(octave >= cut).collect()
    known, logs = pa.array([r["word"] for r in common], pa.string()), np.log10(np.array([r["n"] for r in common], float) + 0.5)
    frequent = spark.sparkContext.broadcast((known, logs, float(np.log10(ends + 0.5)) if ends else None))

    made = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("ids", T.BinaryType()), ("rare", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])))]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(k, t) for k, t in made]])
    encoded = stored(rows.mapInArrow(_encoder(ranks, frequent), schema), "encoded")

    encoding = Tokenizer(ranks.value).encoding
    learned = encoded.where(~F.col("held_out"))
    occur = subword_counts(learned.select("ids"))[: encoding.n_vocab]
    kind, share, sums = classes(occur, initial(encoding), ends)
    weights = initial_weights(sums)
    if ends:
        weights = train(learned.select("ids"), weights, spark.sparkContext.broadcast(kind), int(occur.sum()))

    kept = encoded.select("row", "id", "held_out", "n_tokens", "n_known", "base", "ids")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("n_subwords", T.LongType())])
    out = kept.mapInArrow(_scorer(spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast((kind, share))), schema)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    less = counts.where(octave < cut).select("word", F.col("n").alias("c"))
    rare = rare.join(less, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known")
    )
    out = out.join(rare, "row", "left")
    norm = float(np.log10(n + 0.5 * (v + 1)))
    # without training documents the end is as unknown as any word
    unseen_end = 0.0 if ends else float(np.log10(0.5))
    base = F.col("base") + F.lit(unseen_end) + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_subwords",
    )
