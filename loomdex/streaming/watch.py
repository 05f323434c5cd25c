"""Continuous ingest with Structured Streaming.

:func:`watch` streams files: it sees new ones only. :func:`follow` streams sync passes: edits and deletions arrive too, told by the
registry, which is the state of the stream and survives restarts with the index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomdex.engine import SearchIndex
from loomdex.plans.sync import ingest
from loomdex.sources.files import has_extension

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def extension_glob(extensions: Sequence[str]) -> str:
    """A file name pattern of the extensions in any case; all names without extensions."""
    folded = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*{" + ",".join(folded) + "}" if folded else "*"


def follow(index: SearchIndex, config: Mapping, checkpoint: str, *, interval: str = "1 minute") -> StreamingQuery:
    """Sync the configured folders every ``interval``; a pass that is replayed after a failure changes nothing.

    Triggers come from a rate source, so a slow pass delays the next one and passes never overlap.
    """
    ticks = index.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()

    def each_batch(_ticks: DataFrame, _batch_id: int) -> None:
        index.sync_from_config(config)

    writer = ticks.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()


def watch(
    index: SearchIndex,
    directory: str,
    extensions: Sequence[str],
    checkpoint: str,
    *,
    interval: str | None = None,
) -> StreamingQuery:
    """Start ingesting files of ``directory``: once over everything new, or every ``interval``.

    A batch that is replayed after a failure finds its files registered with the
    same hash and changes nothing.
    """
    stream = (
        index.spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", extension_glob(extensions))  # unwanted files are not opened
        .load(directory)
        .select(
            F.regexp_replace("path", "^file:/+", "/").alias("file_path"),
            F.col("modificationTime").alias("modified_at"),
            "length",
            "content",
        )
        .where(has_extension(F.col("file_path"), extensions))
    )

    def each_batch(files: DataFrame, _batch_id: int) -> None:
        ingest(index.store, files, index.embedder, dim=index.dim, bit_width=index.bit_width, pdf_reader=index.pdf_reader)

    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
