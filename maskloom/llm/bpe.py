"""Byte-level BPE: encoding of whole texts, with long ones cut into overlapping chunks, and decoding.

Texts up to CHUNK characters are encoded as they are. A longer text becomes chunk rows, each with OVERLAP characters of the next
chunk. Every chunk is pre-tokenised by itself, in parallel. Then the boundaries that two neighbours found in their overlap, the
seam, are held against each other: positions only, a group of two rows a seam. From a common boundary on both agree for good,
since the pattern looks only ahead; there the text is cut. So a piece runs from one seam to the next and lies within one chunk
row, which is encoded where it is. Where no boundary is common the text isn't cut, and the chunk rows on both sides go to one
task: a run without any boundary is a single pre-token, which can't be divided. In the end the ids of a text's pieces, and no
text, come together by position.

A null text counts as empty. Repeated rows each give a row. An empty table gives an empty one. Texts may have any length; a text
and its ids are each a value of a row (2 GB at most in Spark). Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, parts, small_batches

CHUNK, OVERLAP = 32_768, 512
#: A pre-token's end may depend on so many characters after it (those of a contraction).
AHEAD = 4


@functools.lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(ranks: str) -> dict[int, bytes]:
    with open(ranks, "rb") as lines:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}


def id_bytes(enc: tiktoken.Encoding, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def boundaries(text: str, pattern: str, last: bool) -> np.ndarray:
    """Starts of pre-tokens. Near the end of a chunk that isn't the last they aren't known for certain and are left out."""
    end = len(text) if last else len(text) - AHEAD
    at = np.fromiter((m.start() for m in regex.finditer(pattern, text)), np.int64)
    return at[at < end]


def certain(text: str, b: int) -> bool:
    """Whether b is a boundary whatever stands around: white space after a letter or digit."""
    x, y = text[b - 1 : b], text[b : b + 1]
    return x.isascii() and x.isalnum() and y in (" ", "\n")


def seams(text: str, i: int, last: bool, pattern: str, chunk: int, overlap: int) -> list[tuple[int, list[int], list[int]]]:
    """What chunk i has to say of the seams before (i - 1) and after it (i): boundaries there, and those of them that are certain.

    Positions are those in the whole text.
    """
    at = boundaries(text, pattern, last)
    out = []
    for seam, a in ((i - 1, 0), (i, chunk)):
        if 0 <= seam and (seam < i or not last):
            there = at[(at >= a) & (at < a + overlap)].tolist()
            out.append((seam, [b + i * chunk for b in there], [b + i * chunk for b in there if certain(text, b)]))
    return out


def cuts(found: list[tuple[int | None, int | None]]) -> list[int | None]:
    """found: of each seam its first certain common boundary and its first common one. Where the text is cut, or null.

    After a seam without a cut the next chunk isn't known to be in step, until a certain boundary.
    """
    out: list[int | None] = []
    in_step = True
    for sure, common in found:
        out.append(sure if sure is not None else common if in_step else None)
        in_step = out[-1] is not None
    return out


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc id and ids: binary, little-endian unsigned 32-bit integers; one row per input row."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for b in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([id_bytes(enc, t.as_py()) for t in b.column(1)], pa.binary())], ["doc_id", "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                n = -(-len(text) // chunk)
                for i in range(n):
                    part = text[i * chunk : (i + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([i], pa.int32()), pa.array([i == n - 1]), pa.array([part])], ["row", "i", "last", "text"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 3):
            out = [(row, *seam) for row, i, last, text in zip(*(c.to_pylist() for c in b.columns)) for seam in seams(text, i, last, pattern, chunk, overlap)]
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["row", "seam", "at", "sure"])

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[(x["sure"], x["common"]) for x in r] for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cuts(x) for x in lists], pa.list_(pa.int64()))], ["row", "cuts"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for b in parts(batches, 2):
            ids = [id_bytes(enc, t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["row", "at", "ids"])

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        return pa.table({"row": rows["row"].slice(0, 1), "ids": pa.array([b"".join(x.as_py() for x in rows["ids"])], pa.binary())})

    short = base.where(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {kind}, ids binary")
    long = cut(base.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    # chunks are dealt out by themselves, so that a long text isn't one task's work
    table = cut(long.select("row", "text").mapInArrow(chunks, "row long, i int, last boolean, text string").repartition("row", "i"), "chunks")
    two = table.mapInArrow(pretokenise, "row long, seam int, at array<long>, sure array<long>").groupBy("row", "seam").agg(F.collect_list("at").alias("at"), F.flatten(F.collect_list("sure")).alias("sure"))
    common = F.array_intersect(F.get("at", F.lit(0)), F.get("at", F.lit(1)))
    seam = F.struct("seam", F.array_min(F.array_intersect("sure", common)).alias("sure"), F.array_min(common).alias("common"))
    by_row = two.select("row", seam.alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))  # 24 bytes for each CHUNK characters
    where = by_row.mapInArrow(stitched, "row long, cuts array<long>").select("row", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "cuts")).alias("i", "begin"), F.concat("cuts", F.array(F.lit(None).cast("long"))).alias("cuts"))
    where = where.select("row", "i", "begin", F.get("cuts", F.col("i")).alias("end"))
    # a chunk row gives its text from its own cut to the next; without a cut of its own it goes on with the row before
    known = table.join(where, ["row", "i"]).withColumn("from", F.coalesce("begin", F.col("i").cast("long") * chunk))
    known = known.withColumn("to", F.coalesce("end", F.when(F.col("last"), F.col("i").cast("long") * chunk + F.length("text")).otherwise((F.col("i").cast("long") + 1) * chunk)))
    known = cut(known.select("row", "i", "begin", F.col("end").isNotNull() | F.col("last"), "from", F.expr(f"substring(text, int(`from` - i * {chunk}) + 1, int(`to` - `from`))").alias("part")).toDF("row", "i", "begin", "ends", "at", "part"), "pieces")
    inner = known.where("begin is not null and ends").select("row", "at", "part")
    runs = known.where("begin is null or not ends")
    order = Window.partitionBy("row").orderBy("i")
    heads = runs.select("row", "i", "begin").withColumn("head", F.last("begin", True).over(order)).select("row", "i", "head")
    run = runs.join(heads, ["row", "i"]).groupBy("row", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("part"))
    encoded = inner.unionByName(run.withColumnRenamed("head", "at")).mapInArrow(pieces, "row long, at long, ids binary")
    ids = encoded.groupBy("row").applyInArrow(joined, "row long, ids binary")
    return short.unionByName(long.select("row", "doc_id").join(ids, "row").select("doc_id", "ids"))


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc id, ids and decoded: the bytes of all tokens, one after the other. Null ids count as none."""
    base = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        for b in batches:
            out = [b"".join(map(table.__getitem__, np.frombuffer(x.as_py(), "<u4").tolist())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")
