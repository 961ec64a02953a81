"""The store and the file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.functions.timetext import srt_text
from cinetable.operators.aggregates import by_frame
from cinetable.operators.fulltext import postings
from cinetable.plans.columns import col

TABLES = ("video", "utterance", "visual_event", "ocr_event", "chunks")


def write_table(df: DataFrame, root: str, name: str, *, sort: tuple[str, ...] = ()) -> None:
    """A table by video (K1, K3): the videos in ``df`` replace theirs, others stay. Rows of a video are spread over files of
    bounded size and sorted, so time filters skip row groups."""
    out = df
    if sort:
        out = df.repartitionByRange(col("video_id"), *(col(c) for c in sort)).sortWithinPartitions("video_id", *(col(c) for c in sort))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(f"{root}/{name}")


def register(spark: SparkSession, root: str, *names: str) -> list[str]:
    """Temporary views over the stored tables that exist."""
    done = []
    for name in names or TABLES:
        path = f"{root}/{name}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            spark.read.parquet(path).createOrReplaceTempView(name)
            done.append(name)
    return done


def detections_csv(detections: DataFrame) -> DataFrame:
    """The tall table in the shape and order of the newest extractor."""
    return detections.select(
        F.col("frame_idx").alias("frame_index"),
        srt_text(F.col("frame_ts")).alias("time"),
        F.round("frame_ts", 3).alias("time_seconds"),
        "label",
        F.round("conf", 6).alias("conf"),
        "x1", "y1", "x2", "y2", "extra",
    ).orderBy("frame_index", "label", F.desc("conf"))


def older_detections_csv(detections: DataFrame) -> DataFrame:
    """The tall table in the shape of the older extractor, without frame numbers (K6)."""
    return detections_csv(detections).drop("frame_index").orderBy("time_seconds", "label", F.desc("conf"))


def ingest_detections_csv(detections: DataFrame) -> DataFrame:
    """The tall table in the shape that the ingest step reads (K6): frame_ts, label, conf, box, extra."""
    return detections.select("frame_ts", "label", "conf", "x1", "y1", "x2", "y2", "extra").orderBy("frame_ts", "label", F.desc("conf"))


def frames_csv(detections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The per-frame table with JSON cells (K5), of one video or, with ``keys`` before the other columns, of many."""
    frames = by_frame(detections, list(keys))
    return frames.select(
        *(col(k) for k in keys),
        F.col("frame_idx").alias("frame_index"),
        srt_text(F.col("time_seconds")).alias("time"),
        F.round("time_seconds", 3).alias("time_seconds"),
        "n_detections",
        "labels",
        F.to_json("class_counts").alias("class_counts_json"),
        F.to_json("objects").alias("objects_json"),
    ).orderBy(*keys, "frame_index")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes are doubled and outer space stays."""
    options = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options).csv(path)


def write_text_index(df: DataFrame, keys: list[str], text: str, root: str, name: str, *, files: int | None = None) -> None:
    """A full-text index beside a table (K3, T9): postings sorted by term, so that a lookup of a word reads few row groups."""
    index = postings(df, keys, text)
    ordered = index.repartitionByRange(files, "term") if files else index.repartitionByRange("term")
    ordered.sortWithinPartitions("term", *keys).write.mode("overwrite").parquet(f"{root}/{name}_fts")


def copy_as(spark: SparkSession, source: str, target: str) -> None:
    """A file under a second name (K11); an existing target is replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    one, other = path(source), path(target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one.getFileSystem(conf), one, other.getFileSystem(conf), other, False, True, conf)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
