"""Extension: articles as they arrive in a folder. Stateless, so no watermark; each micro-batch is the batch transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans import inference
from quillspark.sources import nxml


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(pmcid, content) of .nxml files as a stream."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.nxml")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    name = F.regexp_extract("path", r"([^/]+)\.nxml$", 1)
    return files.select(F.regexp_replace(name, "^PMC", "").alias("pmcid"), "content")


def extract_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the extracted fields of arriving articles as Parquet until what is there now is done."""
    records = inference.extracted(nxml.articles(nxml.parse(arriving(spark, folder))))
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
