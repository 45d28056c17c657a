"""Continuous ingestion: new and rewritten files of a tree, in bounded micro-batches, into an index.

The only state is the index itself (the stored hash of each source), so a batch that runs again changes nothing twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import WINDOW_SOURCES
from ..engine import Engine
from ..functions.text import included

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_tree(engine: Engine, root: str, checkpoint: str, family: str, area: str = "all-docs", files_per_batch: int = WINDOW_SOURCES, continuous: bool = False) -> StreamingQuery:
    """Ingest what lies under `root` and, if `continuous`, what comes later; else stop when all is done.

    Deletions are not seen by a stream; an ordinary update finds them.
    """
    spark = engine.spark
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    tail = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    path = F.substring(F.col("path"), F.instr("path", tail) + len(tail) + 1, F.length("path"))
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.col("length").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.col("content")))
    listing = files.select(path.alias("path"), blob.alias("blob_sha"), F.decode("content", "UTF-8").alias("content")).where(included(F.col("path"), area))

    def batch(df: DataFrame, _: int) -> None:
        # A file rewritten while the stream runs may be there twice.
        engine.update(df.dropDuplicates(["path", "blob_sha"]), family, partial=True)

    w = listing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime="10 seconds") if continuous else w.trigger(availableNow=True)).start()
