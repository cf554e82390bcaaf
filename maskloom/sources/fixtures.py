"""Annotated texts: NAME.txt beside NAME.spans.json, which holds the document's name and its gold spans.

Offsets are in code points of the text as it is, half-open. A pair is checked when it is read: errors tells what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABELS

GOLD = "array<struct<start:int,end:int,label:string,text:string,subtype:string>>"
ANNOTATION = f"doc string, schema_version int, spans {GOLD}"


def validated(text: Column, spans: Column) -> Column:
    """What is wrong with gold spans: an array of messages, each with the span's number; empty if nothing is."""

    def wrong(s: Column, i: Column) -> Column:
        bad = s["start"].isNull() | s["end"].isNull()
        outside = ~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))
        other = F.substr(text, s["start"] + 1, s["end"] - s["start"]) != F.coalesce(s["text"], F.lit(""))
        unknown = ~F.coalesce(s["label"].isin(LABELS), F.lit(False))
        say = lambda what: F.concat(i.cast("string"), F.lit(f": {what}"))
        first = F.when(bad, say("no offsets")).when(outside, say("out of bounds")).when(other, say("another text"))
        return F.filter(F.array(first, F.when(unknown & ~bad & ~outside, say("unknown label"))), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.coalesce(spans, F.array().cast(GOLD)), wrong))


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the name without extension), text, gold, errors: a row for each name of which both files are there."""
    stem = lambda end: F.regexp_replace(F.element_at(F.split("path", "/"), -1), end, "")
    files = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    texts = files("*.txt").select(stem(r"\.txt$").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    notes = files("*.spans.json").select(stem(r"\.spans\.json$").alias("doc_id"), F.from_json(F.decode("content", "UTF-8"), ANNOTATION).alias("a"))
    both = texts.join(notes, "doc_id")
    misnamed = F.when(~F.col("a.doc").eqNullSafe(F.concat("doc_id", F.lit(".txt"))), F.array(F.concat(F.lit("annotation of "), F.coalesce("a.doc", F.lit("nothing"))))).otherwise(F.array().cast("array<string>"))
    return both.select("doc_id", "text", F.coalesce("a.spans", F.array().cast(GOLD)).alias("gold"), F.concat(misnamed, validated(F.col("text"), F.col("a.spans"))).alias("errors"))
