"""Detection CSV files and JSONL as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinetable.functions.jsontext import json_field
from cinetable.operators.positions import with_position
from cinetable.plans.columns import col
from cinetable.schemas import CHUNK, DETECTION_CSV
from cinetable.sources.faulty import assemble_lines, csv_lines, parse_records

REQUIRED = tuple(f.name for f in DETECTION_CSV)


def read_detections(spark: SparkSession, path: str, video_id: str) -> DataFrame:
    """The detections of a video, of either extractor's shape: required columns, then whatever else the file has.

    ``frame_ts`` is taken from ``time_seconds`` where the file has no ``frame_ts``.
    Missing required columns raise before any row is read."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    names = raw.columns
    have = set(names) | ({"frame_ts"} if "time_seconds" in names else set())
    if missing := [c for c in REQUIRED if c not in have]:
        raise ValueError(f"missing columns: {missing}")
    if "frame_ts" not in names:
        raw = raw.withColumn("frame_ts", F.col("time_seconds"))
    kinds = {f.name: f.dataType for f in DETECTION_CSV}
    typed = [col(c).try_cast(kinds[c]).alias(c) if kinds[c] != T.StringType() else col(c) for c in REQUIRED]
    others = [col(c) for c in names if c not in REQUIRED]
    return raw.select(F.lit(video_id).alias("video_id"), *typed, *others)


def visual_events(detections: DataFrame, order: list[str]) -> DataFrame:
    """Detections as events: event_id (1, 2, ... per video in ``order``), video_id, ts, ..., ocr_text, is_ocr."""
    placed = with_position(detections, ["video_id"], order, "event_id").withColumn("event_id", F.col("event_id") + 1)
    text = json_field(F.col("extra"), "$.text")
    is_ocr = F.coalesce(F.lower("label") == "text", F.lit(False)) & text.isNotNull()
    others = [c for c in placed.columns if c not in ("event_id", "video_id", "frame_ts")]
    return placed.select(
        "event_id", "video_id", F.col("frame_ts").alias("ts"), *(col(c) for c in others), text.alias("ocr_text"), is_ocr.alias("is_ocr")
    )


def ocr_events(events: DataFrame) -> DataFrame:
    """event_id, video_id, ts and ocr_text of the events that are screen text."""
    return events.where("is_ocr").select("event_id", "video_id", "ts", "ocr_text")


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks stored as JSON lines, with a fixed schema."""
    return spark.read.schema(CHUNK).json(path)


def read_raw_records(spark: SparkSession, *paths: str, header: bool = True, fields: int | None = None) -> DataFrame:
    """path, record_no and raw of the records of CSV files; a line end inside quotes doesn't end a record.

    A file is assembled by one task in linear time; files are spread over tasks. A record whose quote never
    closes ends with its line. ``fields`` or else the header tells how many fields a record over several lines has."""
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    schema = "path string, record_no bigint, raw string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = csv_lines(text)
                width = fields or (lines[0].count(",") + 1 if header and lines else None)
                records = [r.rstrip("\r\n") for r in assemble_lines(lines, width)][int(header) :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(records), pa.string()), pa.array(range(len(records)), pa.int64()), pa.array(records, pa.string())],
                    names=["path", "record_no", "raw"],
                )

    return files.mapInArrow(run, schema)


def read_detections_with_faults(spark: SparkSession, *paths: str, header: bool = True) -> DataFrame:
    """Typed detections and, with a reason, the records that aren't: path, record_no, fields, raw_record, reason."""
    return parse_records(read_raw_records(spark, *paths, header=header, fields=len(REQUIRED)), "detection", keep=["path", "record_no"])
