"""Token ids packed into fixed rows: best-fit decreasing with a segment tree over free capacities.

Texts are tokenised with a public byte-level BPE vocabulary (a parameter; read on the driver, sent to the
workers as bytes) and end with one end-of-text id. Documents longer than a row give whole rows first; the
rest of each is packed with others: largest first, into the open row with the least sufficient room. A
segment tree over capacities answers that search in log(row length) steps. Packing runs in pools of
POOL_TOKENS within a partition, so memory is bounded, nothing is shuffled, and a lost task is simply run
again.

A result row is a packed row: ids as little-endian uint16 padded to the row length, cumulative segment
lengths (0 first), the offsets at which positions start again from zero, and for each segment its document,
an ordinal that tells repeated rows apart, and its piece number. `unpack` puts documents together again.

Defined cases: null and empty texts are one end-of-text id; null ids stay null; ids are whole numbers (or strings of
digits: others raise); repeated rows are packed each; very long texts are encoded whole and cut into full rows and a
rest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROW, POOL_TOKENS, CACHE, END = 2048, 1 << 21, 100_000, 50256
#: Fixed value: how byte-level BPE cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "bin_id string, n_tokens int, n_segments int, doc_ids array<bigint>, ordinals array<bigint>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"
_OWN: dict = {}


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Tokenizer:
    """Ids of whole texts. Texts without two spaces in a row fall apart at each space into chunks that BPE treats
    independently, so chunks seen before come from a bounded cache; other texts are encoded in one go."""

    def __init__(self, ranks: bytes, end: int = END):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end, self.seen = end, {}

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if "  " in text or len(text) > 1 << 22:
            parts = [self.encoding.encode_ordinary(text)]
        else:
            first, *rest = text.split(" ")
            if len(self.seen) > CACHE:
                self.seen.clear()
            parts, seen, encode = [self.encoding.encode_ordinary(first)], self.seen, self.encoding.encode_ordinary
            for w in rest:
                got = seen.get(w)
                if got is None:
                    got = seen[w] = tuple(encode(" " + w))
                parts.append(got)
        out = [i for p in parts for i in p]
        out.append(self.end)
        return np.array(out, np.uint16)

    def decode(self, ids) -> str:
        return self.encoding.decode([int(i) for i in ids if i != self.end])


def tokenizer(ranks) -> Tokenizer:
    """The worker's tokenizer for a broadcast vocabulary; made once per process, anew when another vocabulary was sent."""
    if _OWN.get("ranks") != ranks.value:
        _OWN.update(ranks=ranks.value, tokenizer=Tokenizer(ranks.value))
    return _OWN["tokenizer"]


class Capacities:
    """A segment tree over free room 0..size: how many open rows have it. find(n): the least room of at least n, or -1."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.tree = [0] * (2 * self.n)

    def add(self, room: int, by: int = 1) -> None:
        i = room + self.n
        while i:
            self.tree[i] += by
            i >>= 1

    def find(self, n: int) -> int:
        i, tree = n + self.n, self.tree
        if tree[i]:
            return n
        while i > 1:  # up to the first right sibling that has rows, then down to its leftmost leaf
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def best_fit(sizes: list[int], row: int) -> list[list[int]]:
    """Indices of sizes by row; sizes are at most row. Largest first, ties in the given order."""
    tree, open_rows, rows = Capacities(row), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.find(sizes[i])
        if room < 0:
            r, room = len(rows), row
            rows.append([])
        else:
            r = open_rows[room].pop()
            tree.add(room, -1)
        rows[r].append(i)
        if left := room - sizes[i]:
            open_rows.setdefault(left, []).append(r)
            tree.add(left)
    return rows


def _packer(ranks, row: int, pool_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = tokenizer(ranks), TaskContext.get().partitionId()
        schema = pa.schema([
            ("bin_id", pa.string()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ordinals", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
            ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("input_ids", pa.binary()),
        ])
        made: list[tuple] = []
        pool: list[tuple] = []
        state = {"held": 0, "bin": 0, "doc": 0}

        def emit(segments: list[tuple]) -> None:
            ends = np.cumsum([len(s[3]) for s in segments]).tolist()
            ids = np.full(row, encode.end, "<u2")
            ids[: ends[-1]] = np.concatenate([s[3] for s in segments])
            made.append((f"{task:07d}-{state['bin']:07d}", ends[-1], len(segments), [s[0] for s in segments], [s[1] for s in segments], [s[2] for s in segments], [0, *ends], [0, *ends[:-1]], ids.tobytes()))
            state["bin"] += 1

        def drain(force: bool = False) -> Iterator[pa.RecordBatch]:
            while len(made) >= (1 if force else 256):
                some = made[:256]
                del made[:256]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

        def pack() -> None:
            for members in best_fit([len(p[3]) for p in pool], row):
                emit([pool[i] for i in members])
            pool.clear()
            state["held"] = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                for k in range(0, len(ids), row):
                    piece = (doc_id, task << 33 | state["doc"], k // row, ids[k : k + row])
                    if len(piece[3]) == row:
                        emit([piece])
                    else:
                        pool.append(piece)
                        state["held"] += len(piece[3])
                state["doc"] += 1
                if state["held"] >= pool_tokens:
                    pack()
                yield from drain()
        pack()
        yield from drain(True)
        encode.seen.clear()  # workers stay, idle, while other stages run
        pa.default_memory_pool().release_unused()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, row: int = ROW, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """docs' texts as packed rows of token ids."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(vocabulary(path))  # a vocabulary file, under 1 MB
    return docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_packer(ranks, row, pool_tokens), SCHEMA)


def positions(cu_seqlens, row: int = ROW) -> np.ndarray:
    """Position ids of a packed row: from zero in each segment, zero in the padding."""
    out = np.zeros(row, np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ordinal, ids): each document's ids as little-endian uint16 bytes, from its pieces in order."""
    seg = packed.select("input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "ordinals", "pieces")).alias("i", "s"))
    seg = seg.select("s.*", F.expr("substring(input_ids, 2 * cu_seqlens[i] + 1, 2 * (cu_seqlens[i + 1] - cu_seqlens[i]))").alias("ids"))
    out = seg.groupBy("doc_ids", "ordinals").agg(F.array_sort(F.collect_list(F.struct("pieces", "ids"))).alias("p"))
    return out.select(F.col("doc_ids").alias("doc_id"), F.col("ordinals").alias("ordinal"), F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
