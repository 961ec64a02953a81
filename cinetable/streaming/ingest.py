"""New subtitle files into the store as they arrive (ST3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinetable.sinks.store import write_table
from cinetable.sources.transcripts import parse_subtitles


def ingest_subtitles(spark: SparkSession, folder: str, root: str, checkpoint: str, *, lenient: bool = True, glob: str = "*.srt") -> StreamingQuery:
    """Starts the query. A file's stem is its video_id; a file that comes again replaces its video, so a
    repeated batch changes nothing."""
    files = (
        spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )

    def store(batch: DataFrame, _: int) -> None:
        stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
        cues = parse_subtitles(batch, lenient=lenient).withColumn("video_id", stem).drop("path", "position").persist()
        try:  # the bounds of the sorted files come from a sample, for which the files would be read once more
            write_table(cues, root, "utterance", sort=("start_sec",))
        finally:
            cues.unpersist()

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
