"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

UTTERANCE = _of(("video_id", _S), ("utt_id", _L), ("start_sec", _D), ("end_sec", _D), ("speaker", _S), ("text", _S))
DETECTION_CSV = _of(("frame_ts", _D), ("label", _S), ("conf", _D), ("x1", _D), ("y1", _D), ("x2", _D), ("y2", _D), ("extra", _S))
DETECTION_CSV_NEW = _of(
    ("frame_index", _I), ("time", _S), ("time_seconds", _D), ("label", _S), ("conf", _D), ("x1", _D), ("y1", _D), ("x2", _D), ("y2", _D), ("extra", _S)
)
VISUAL_EVENT = _of(("event_id", _L), ("video_id", _S), ("ts", _D), *((f.name, f.dataType) for f in DETECTION_CSV[1:]), ("ocr_text", _S), ("is_ocr", T.BooleanType()))
OCR_EVENT = _of(("event_id", _L), ("video_id", _S), ("ts", _D), ("ocr_text", _S))
CHUNK = _of(("chunk_id", _S), ("start_sec", _D), ("end_sec", _D), ("start_srt", _S), ("end_srt", _S), ("text", _S))
