"""Document fingerprints by winnowing.

A rolling hash goes over the k code points from each position. Of every w hashes in a row the smallest is chosen, the
rightmost one on ties, and kept with its position. Two texts that share k + w - 1 code points in a row share a hash.
A text of fewer than k code points is one gram; of fewer than w hashes, the smallest is chosen. The empty text has none.
With k = 8 and w = 16 that is 23 code points, and about 2 of 17 hashes are kept.

A null text counts as empty. Each input row gives a row, repeated rows too; of equal hashes in a window the rightmost is chosen.
An empty table gives an empty one. Other columns are ignored, whatever their names. A text of any length is fingerprinted whole;
some 60 bytes are held for each of its code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, parts, small_batches

K, W = 8, 16
#: Code points of the texts that go together as one compressed row between the passes, unless one text has more.
BLOCK = 1 << 18
M = np.uint64(0x9E3779B97F4A7C15)
#: Zstandard's levels for single texts and for blocks.
TEXT_LEVEL, BLOCK_LEVEL = 5, 7
#: Bits of a position within a block; a block and its neighbour overlap by a window.
BITS = 24


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, k: int) -> np.ndarray:
    """40-bit hashes of all k-grams: a polynomial that doubles its reach until it spans k."""
    points = mixed(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
    k = min(k, len(points))
    if not k:
        return np.zeros(0, np.uint64)
    total, reach, block, span, factor, grown = None, 0, points, 1, M, np.uint64(1)
    rest = k
    with np.errstate(over="ignore"):
        while rest:  # block[i] is the polynomial of span points from i; total has those of reach points
            if rest & 1:
                total, reach = (block, span) if total is None else (total[: len(total) - span] * factor + block[reach:][: len(total) - span], reach + span)
            rest >>= 1
            if rest:
                block, factor, span = block[: len(block) - span] * factor + block[span:], factor * factor, span * 2
        return mixed(total) >> np.uint64(24)


def chosen(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing picks from the hashes, ascending."""
    w = min(w, len(h))
    if not w:
        return np.zeros(0, np.int64)
    out, step = [], (1 << BITS) - w
    for a in range(0, len(h) - w + 1, step):
        part = h[a : a + step + w - 1]
        low = (part << np.uint64(BITS)) | (np.uint64((1 << BITS) - 1) - np.arange(len(part), dtype=np.uint64))
        span = 1
        while span < w:
            move = min(span, w - span)
            low = np.minimum(low[:-move], low[move:])
            span += move
        low = low[np.concatenate([[True], low[1:] != low[:-1]])]
        out.append(a + ((1 << BITS) - 1 - (low & np.uint64((1 << BITS) - 1)).astype(np.int64)))
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their positions."""
    h = gram_hashes(text, k)
    at = chosen(h, w)
    return h[at], at


def as_text(fp: tuple[np.ndarray, np.ndarray]) -> str:
    """hash@position in hexadecimal digits, by position."""
    digits = lambda a, kind: np.frombuffer(a.astype(kind).tobytes().hex().encode(), np.uint8).reshape(len(a), -1)
    if not len(fp[0]):
        return ""
    one = np.ones((len(fp[0]), 1), np.uint8)
    cells = np.concatenate([digits(fp[0], ">u8")[:, 6:], one * ord("@"), digits(fp[1], ">u4"), one * ord(" ")], axis=1)
    ends = np.searchsorted(fp[1], [16**n for n in range(1, 9)]).tolist()  # positions ascend: those of n digits stand together
    parts = [np.concatenate([cells[i:j, :11], cells[i:j, 18 - n :]], axis=1).tobytes() for n, (i, j) in enumerate(zip([0, *ends], ends)) if i < j]
    return b"".join(parts)[:-1].decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of the sets of hashes; 1 for two without any."""
    return likeness_of_sets(np.unique(a[0]), np.unique(b[0]))


def likeness_of_sets(x: np.ndarray, y: np.ndarray) -> float:
    """The same of sorted distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (hash@position, by position) of every text; a null text counts as empty."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([as_text(fingerprint(t, k, w)) for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document by ascending id; after the last comes the first.

    Null ids come first; rows of one id follow each other by a hash of their text. A null text counts as empty. A document
    alone is its own next. Texts, each compressed, are dealt out by ranges of ids and sorted; a task cuts its range into blocks
    of texts in a row, each with the text that follows it, and writes them down. The last block of each range waits for the
    first text of the next range. Fingerprints are made from the blocks, on the way out: no table holds them in between.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def row(text: str, fp: tuple, hashes: np.ndarray, following: str, next_hashes: np.ndarray) -> tuple:
        new = edited(text, following)
        new_fp = fingerprint(new, k, w)
        return len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(fp), as_text(new_fp), likeness_of_sets(hashes, np.unique(new_fp[0])), likeness_of_sets(hashes, next_hashes)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=TEXT_LEVEL)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([coder.compress(t.as_py().encode()) for t in b.column(1)], pa.binary())], ["doc_id", "hash", "squeezed"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decoder = zstandard.ZstdCompressor(level=BLOCK_LEVEL), zstandard.ZstdDecompressor()
        part, schema, first, ids, texts, size = TaskContext.get().partitionId(), None, None, [], [], 0

        def out(following: bytes | None) -> pa.RecordBatch:
            raw = [t.encode() for t in texts]
            cols = [pa.array([part], pa.int32()), pa.array([ids], pa.list_(schema)), pa.array([list(map(len, raw))], pa.list_(pa.int64())), pa.array([coder.compress(b"".join(raw))], pa.binary()), pa.array([following], pa.binary()), pa.array([None if following else first], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "ids", "sizes", "block", "following", "first"])

        for b in batches:
            schema = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(2)):
                small = t.as_py()
                text = decoder.decompress(small).decode()
                first = small if first is None else first
                if texts and size + len(text) > BLOCK:
                    yield out(small)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield out(None)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = zstandard.ZstdDecompressor()
        for b in batches:
            for n in range(b.num_rows):
                raw, texts, at = decoder.decompress(b.column(2)[n].as_py()), [], 0
                for size in b.column(1)[n].as_py():
                    texts.append(raw[at : at + size].decode())
                    at += size
                texts.append(decoder.decompress(b.column(3)[n].as_py()).decode())
                fps = [fingerprint(t, k, w) for t in texts]
                sets = [np.unique(fp[0]) for fp in fps]
                rows = [row(*x) for x in zip(texts, fps, sets, texts[1:], sets[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0)[n].values, *(pa.array(c) for c in zip(*rows))], ["doc_id", *names])

    names = [x.split()[0] for x in FIELDS.split(", ")]
    small = base.withColumn("hash", F.xxhash64("text")).mapInArrow(squeezed, f"doc_id {kind}, hash long, squeezed binary")
    # ranges of id and hash: rows of one id (or of none) are dealt out too
    dealt = small.repartitionByRange(F.col("doc_id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash")
    table = cut(dealt.mapInArrow(blocks, f"part int, ids array<{kind}>, sizes array<long>, block binary, following binary, first binary"), "ranges")
    edges = table.where("following is null")
    numbers = sorted(r["part"] for r in edges.select("part").collect())  # a number per partition that has rows: 16 MB for a million
    after = docs.sparkSession.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "part int, next_part int")
    ends = edges.drop("following").join(F.broadcast(after), "part").join(edges.select(F.col("part").alias("next_part"), F.col("first").alias("following")), "next_part")
    columns = ("ids", "sizes", "block", "following")
    return table.where("following is not null").select(*columns).unionByName(ends.select(*columns)).mapInArrow(rows_of, f"doc_id {kind}, {FIELDS}")
