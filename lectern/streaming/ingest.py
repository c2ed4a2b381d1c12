"""Incremental ingest: new files of documents become documents and chunks, once each.

The stream only finds files; each micro-batch runs the same functions as the batch engine.
Content that is stored already is skipped, so replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chunking import word_chunks
from lectern.operators.storage import get_or_create

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_batch(batch: DataFrame, target: str) -> None:
    """Append the batch's new documents and their chunks. Chunks go first: a document row says that they are there."""
    spark = batch.sparkSession
    arriving = batch.where("text is not null").withColumn("sha", F.sha2("text", 256))
    new = get_or_create(stored(spark, f"{target}/documents", "doc_id bigint, sha string").select("sha"), arriving)
    new.persist()
    known = stored(spark, f"{target}/chunks", "doc_id bigint, chunk_index int, text string").select("doc_id").distinct()
    word_chunks(new.join(known, "doc_id", "left_anti")).write.mode("append").parquet(f"{target}/chunks")
    new.write.mode("append").parquet(f"{target}/documents")
    new.unpersist()


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Ingest all files that are in a folder now and haven't been taken before; ends when they are done."""
    files = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", 16).parquet(source)
    return files.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
