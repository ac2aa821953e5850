"""Streaming ingest: files that arrive in a folder become raw blocks; per-document work runs on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.documents import Documents
from docloom.sources import extract

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """path and content of files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", str(per_trigger)).load(path).select("path", "content")


def raw_block_stream(files: DataFrame) -> DataFrame:
    """Raw blocks of the arriving files: a map without state."""
    return extract.raw_blocks(extract.extract_files(files))


def write_documents(files: DataFrame, sink: Callable[[Documents, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of whole files as `Documents` to `sink`; a document never spans batches, so its windows are whole."""
    writer = files.writeStream.foreachBatch(lambda batch, n: sink(Documents.from_files(batch), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
