"""Reading texts from files and writing them and their audit bundle."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verify import audit_entries, audit_summary, document_audit, html_diff, leaking


class UnsupportedFormat(ValueError):
    """No reader or writer for that extension."""


def extension(path: str) -> str:
    """In lower case with its dot, or ''."""
    return os.path.splitext(path)[1].lower()


def read_texts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """doc_id (the path) and text, a row per file; a byte order mark goes, line ends stay. Bytes that aren't text raise."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.decode("content", encoding).alias("text"))
    return raw.select("doc_id", F.regexp_replace("text", "^﻿", "").alias("text"))


def write_texts(df: DataFrame, folder: str, text_col: str = "redacted", id_col: str = "doc_id", encoding: str = "UTF-8", newline: str | None = None) -> None:
    """A file per row, named like the row's, byte for byte; newline, if given, takes the place of every line end.

    Two rows of one file name would overwrite each other: that is an error before anything is written.
    """
    base = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = F.element_at(F.split("id", "/"), -1)
    if (twice := base.groupBy(name.alias("name")).count().where("count > 1").first()) is not None:
        raise ValueError(f"{twice['count']} rows would be written to one file {twice['name']!r}")

    def put(rows: object) -> None:
        from pyarrow import fs

        for r in rows:
            store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
            store.create_dir(root, recursive=True)
            text = r[1] if newline is None else re.sub("\r\n|\r|\n", lambda _: newline, r[1])
            with store.open_output_stream(f"{root}/{os.path.basename(r[0])}", compression=None) as out:
                out.write(text.encode(encoding))

    base.foreachPartition(put)


READERS: dict[str, Callable[..., DataFrame]] = {".txt": read_texts, ".parquet": lambda spark, path, **kw: spark.read.parquet(path), ".jsonl": lambda spark, path, **kw: spark.read.json(path)}
WRITERS: dict[str, Callable[..., None]] = {".txt": write_texts, ".parquet": lambda df, path, **kw: df.write.parquet(path), ".jsonl": lambda df, path, **kw: df.write.json(path)}


def register_reader(ext: str, read: Callable[..., DataFrame]) -> None:
    READERS[ext.lower()] = read


def register_writer(ext: str, write: Callable[..., None]) -> None:
    WRITERS[ext.lower()] = write


def read_file(spark: SparkSession, path: str, **options: object) -> DataFrame:
    if extension(path) not in READERS:
        raise UnsupportedFormat(f"no reader for {extension(path) or path!r}")
    return READERS[extension(path)](spark, path, **options)


def write_file(df: DataFrame, path: str, kind: str | None = None, **options: object) -> None:
    ext = kind or extension(path)
    if ext not in WRITERS:
        raise UnsupportedFormat(f"no writer for {ext or path!r}")
    WRITERS[ext](df, path, **options)


def write_bundle(df: DataFrame, folder: str, secret: str | None = None, id_col: str = "doc_id") -> None:
    """audit, summary, documents, plan, verification (JSON) and diff (a column of HTML) of what redact() gives. Refused if the secret shows."""
    diff = df.select(id_col, html_diff(F.col("norm"), F.col("redacted"), F.col("plan")).alias("html"))
    entries = audit_entries(df, id_col)
    parts = {"audit": entries, "summary": audit_summary(entries), "documents": document_audit(df, secret, id_col), "plan": df.select(id_col, "plan"), "verification": df.select(id_col, "report", "findings"), "diff": diff}
    for name, part in parts.items():
        if not leaking(part, secret, part.columns).isEmpty():
            raise ValueError(f"the secret stands in {name}; nothing of it was written")
    for name, part in parts.items():
        part.write.json(f"{folder}/{name}")
