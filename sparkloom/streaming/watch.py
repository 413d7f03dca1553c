"""Updates as files arrive: a file stream that runs the same update job for each batch."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.embedders import Embedder
from ..plans.index import update
from ..sources.files import SUFFIXES
from ..storage import shared_dir


def watch(spark: SparkSession, path: str, db: str, embedder: Embedder | None = None, once: bool = True) -> StreamingQuery:
    """A stream over new and changed files under path. Each batch updates the stored graph by digests, so a batch that
    runs twice changes nothing; deletions show with the next batch. once: ends when what is there has been seen."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(f"*{s}" for s in SUFFIXES) + "}").load(path).select("path")

    def job(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            update(spark, path, db, embedder)

    out = files.writeStream.foreachBatch(job).option("checkpointLocation", f"{shared_dir(spark)}/watch-{sha256(f'{path}\0{db}'.encode()).hexdigest()[:32]}")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()
