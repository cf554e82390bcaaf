"""A pipeline that turns raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
``documents``. Results are written as Parquet in the shared folder and read again. What a stage wrote on its way is deleted when
the next one begins, unless that one's docs still read it.

1. quality: documents that the quality rules reject go.
2. lines: later places of repeated three-line windows are removed; a document that loses all its lines stays as an empty one.
3. near: of each group of near copies (five words, similarity 0.8 or more) one document stays, that of the smallest id.
4. secrets: every secret found is replaced in the text.
5. packing: what is left is cut into sequences of 2048 ids.

n_chars is kept in step with the text. Extra columns go through all stages but packing, whatever their names.

Null texts fail the quality rules for having no words; a null source is a source of its own; a null doc_id counts as largest where
the smallest id decides. Repeated rows are judged each; lines of all but one of them go in stage 2, so that they stay as empty
documents, which are near copies of nothing. Of rows with one id and text the first as read stays whole. Texts of any length
are worked on whole. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import jaccard, lines, packing, quality, secrets
from maskloom.llm.shared import cut, discard, documents, read_by, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stage before wrote on its way, by application and input.
_left: dict[tuple[str, str], list[DataFrame]] = {}


def tidied(stage: Stage) -> Stage:
    """The stage, which first deletes what the one before it left."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        kept = tidy(spark, docs, sf_dir)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left[key] = kept + made
        return out

    return run_stage


def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> list[DataFrame]:
    """Deletes what the stage before wrote on its way; the tables that docs still reads are returned."""
    left = _left.pop((spark.sparkContext.applicationId, sf_dir), [])
    kept = read_by(docs, left)
    discard(spark, *(t for t in left if t not in kept))
    return kept


def with_text(done: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of row with its text replaced, and n_chars to match."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return done.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(lines.dedup(docs), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, carry=True)
    return with_text(found.withColumn("text", secrets.redacted(F.col("row.text"), F.col("all"))), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [(name, tidied(stage)) for name, stage in (("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("secrets", secrets_stage), ("packing", packing_stage))]

#: Packing's ids can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        tidy(spark, docs, sf_dir)
        discard(spark, *before)
        before = [docs]
    return docs
