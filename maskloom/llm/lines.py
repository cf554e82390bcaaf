"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines of a text, told apart from others by the MD5 of its bytes; one without a word doesn't
count. Of the places where a window stands, the first stays: that of the smallest document id (nulls last), there the first.
Every line that a later place covers is removed; a text of fewer than three lines stays whole. Rows with one id are told
apart by text and then by place, so that of repeated rows one stays whole. A null text stays null and has no lines. Texts of any
length are read whole. An empty table gives an empty one. Other columns are carried in ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, cut, discard, let

WIDTH = 3


def windows(lines: Column, width: int = WIDTH) -> Column:
    """Structs of at and key: each window that has a word."""

    def window(i: Column) -> Column:
        text = F.array_join(F.slice(lines, i + 1, width), "\n")
        return F.struct(i.alias("at"), F.when(text.rlike(f"[^{SPACE}]"), F.unhex(F.md5(text))).alias("key"))

    found = F.transform(F.sequence(F.lit(0), F.size(lines) - width), window)
    return F.when(F.size(lines) >= width, F.filter(found, lambda w: w["key"].isNotNull()))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """row: a struct of all input columns; text: what is left; n_lines, n_removed.

    Windows go to a table; first places come from a partial minimum by window, so a window that stands in a third of all
    documents costs each task one row. Only windows that repeat are joined back, as tables whose skewed keys Spark splits.
    """
    base = cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("place")), "documents")
    base = base.select("row", "place", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    found = base.select(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.xxhash64("text").alias("hash"), F.col("place")).alias("doc"), F.explode(let(F.split("text", "\n", -1), lambda x: windows(x, width))).alias("w"))
    found = cut(found.select("w.key", "doc", F.col("w.at").alias("at")), "windows")
    repeated = cut(found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first")).where("n > 1").drop("n"), "repeated")
    discard(docs.sparkSession)
    later = found.join(repeated, "key").where(F.struct("doc", "at") != F.col("first")).select("doc.place", "at")
    covered = later.groupBy("place").agg(F.collect_list("at").alias("at"))  # at most a document's lines

    def left(lines: Column, at: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + width - 1))))
        stay = lambda g: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g), lambda i: F.get(lines, i))
        return let(gone, lambda g: F.struct(F.array_join(stay(g), "\n").alias("text"), F.size(g).alias("n")))

    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    joined = base.join(covered, "place", "left")
    done = joined.select("row", "text", n_lines.cast("long").alias("n_lines"), F.when(F.col("at").isNotNull(), let(F.split("text", "\n", -1), lambda x: left(x, F.col("at")))).alias("left"))
    return done.select("row", F.when(F.col("left").isNull(), F.col("text")).otherwise(F.col("left.text")).alias("text"), "n_lines", F.coalesce("left.n", F.lit(0)).cast("long").alias("n_removed"))
