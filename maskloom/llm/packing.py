"""Packing: documents laid end to end as one stream of token ids, cut into windows of equal length.

First pass: every partition encodes its documents and notes where each begins within the partition; this goes to a table.
The partitions' totals, one number each, are summed up on the driver and give each partition its place in the stream.
Second pass: a document's place is its partition's plus its own, and the windows it reaches into follow by arithmetic, a
record for each piece between two boundaries. All windows but the last are full. Nothing is shuffled.

A null text counts as empty: such a document is only the end id. Repeated rows are packed each. Texts of any length are encoded
whole, in batches bounded by bytes; one text's ids are a row. An empty table gives no pieces. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, parts, small_batches


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """An encoder with the vocabulary of a byte-level BPE file of the tokenizers library, whose ids are in order of the merges.

    It gives the same ids as that library (tests hold it against it), some five times as fast. The file's added tokens in a text
    are one id each, as by that library's defaults.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {x["content"]: x["id"] for x in vocabulary.get("added_tokens", ()) if x.get("special")}
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    ranks = {bytes(byte_of[c] for c in token): n for token, n in vocabulary["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def tokenised(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, at: where the document begins in its partition; doc_id, n: its ids with the end id; ids: binary, 4 bytes each."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in parts(batches, 1):
            ids = [enc.encode_to_numpy(t.as_py(), allowed_special="all").astype("<u4", copy=False).tobytes() + end for t in b.column(1)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), b.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "at", "doc_id", "n", "ids"])

    return base.mapInArrow(run, f"part int, at long, doc_id {base.schema['doc_id'].dataType.simpleString()}, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, pattern: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start (in the document), length, ids (binary), doc_tokens, sequence_id, offset (in the sequence).

    The partitions' places are broadcast: a row of two numbers for each partition, 16 MB for a million of them.
    """
    spark = docs.sparkSession
    table = cut(tokenised(docs, tokenizer, pattern, end_id, id_col, text_col), "tokens")
    totals = sorted(table.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n")).collect())  # a row per partition
    bases = np.concatenate([[0], np.cumsum([r["n"] for r in totals], dtype=np.int64)])
    places = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(totals, bases)], "part int, base long")
    doc = table.join(F.broadcast(places), "part").select("doc_id", "ids", F.col("n").alias("doc_tokens"), (F.col("base") + F.col("at")).alias("g"))

    def piece(s: Column) -> Column:
        a, b = F.greatest(F.col("g"), s * length), F.least(F.col("g") + F.col("doc_tokens"), (s + 1) * length)
        ids = F.substring("ids", ((a - F.col("g")) * 4 + 1).cast("int"), ((b - a) * 4).cast("int"))
        return F.struct((a - F.col("g")).alias("start"), (b - a).alias("length"), s.alias("sequence_id"), (a - s * length).alias("offset"), ids.alias("ids"))

    pieces = F.transform(F.sequence(F.expr(f"g div {length}"), F.expr(f"(g + doc_tokens - 1) div {length}")), piece)
    return doc.select("doc_id", "doc_tokens", F.inline(pieces))
