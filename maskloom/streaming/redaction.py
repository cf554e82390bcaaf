"""Redaction of streams: the batch plan over a streaming DataFrame, and leakage over event time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.redaction import redact
from ..schema import Config


def stream_redact(stream: DataFrame, cfg: Config | None = None, text_col: str = "text") -> DataFrame:
    """The same projections as for batches. Names stay the same between batches by the keyed scope, not by state."""
    return redact(stream, (cfg or Config()).but(cross_doc_consistency=True), text_col)


def leakage_over_time(redacted: DataFrame, time_col: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Documents, residuals and scores by window of event time; rows later than ``late`` are left out."""
    return redacted.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(F.count("*").alias("documents"), F.sum("report.residual_count").alias("residuals"), F.sum("report.score").alias("score"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_files(spark: SparkSession, path: str, cfg: Config | None = None, text_col: str = "text") -> DataFrame:
    """Redacts the Parquet files at a path as a stream that ends with what is there now, and reads the result.

    Result and checkpoint go to the folder that the cluster shares (spark.checkpoint.dir); without one, a local master gets its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskloom-")
    folder = f"{base.rstrip('/')}/maskloom-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    name = path.rstrip("/").rsplit("/", 1)[1]
    one_file = spark.read.parquet(path).inputFiles()[:1] == [path] or path in {f.removeprefix("file://") for f in spark.read.parquet(path).inputFiles()[:1]}
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", name).parquet(path.rstrip("/").rsplit("/", 1)[0]) if one_file else reader.parquet(path)
    query = write(stream_redact(stream, cfg, text_col).drop("spans", "plan", "findings", "report"), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
