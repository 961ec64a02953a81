"""Aggregates over detections and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetable.functions.jsontext import json_field
from cinetable.functions.text import normal_text
from cinetable.operators.windows import top_per_group
from cinetable.plans.columns import col


def by_frame(detections: DataFrame, keys: list[str], frame: str = "frame_idx") -> DataFrame:
    """One row per frame (G2, G3): keys, frame, time, n_detections, labels, class_counts, objects.

    Objects are in order of label, falling confidence, then ``det_id``; ``time``
    is the first object's frame_ts; ``labels`` joins all labels, repeats
    included; ``class_counts`` maps labels to counts. Null labels count as "",
    rows without a frame are left out.
    """
    label = F.coalesce("label", F.lit(""))
    item = F.struct(
        label.alias("label"),
        (-F.coalesce("conf", F.lit(-1.0))).alias("rank"),
        F.col("det_id"),
        F.col("conf"),
        F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"),
        F.col("frame_ts"),
        F.col("extra"),
    )
    grouped = detections.where(col(frame).isNotNull()).groupBy(*keys, frame).agg(F.array_sort(F.collect_list(item)).alias("items"))
    labels = F.transform("items", lambda x: x["label"])
    counts = F.map_from_entries(
        F.transform(
            F.array_distinct(labels), lambda name: F.struct(name, F.size(F.filter(labels, lambda x: x == name)).cast("bigint"))
        )
    )
    return grouped.select(
        *keys,
        frame,
        F.get("items", F.lit(0))["frame_ts"].alias("time_seconds"),
        F.size("items").alias("n_detections"),
        F.array_join(labels, ";").alias("labels"),
        counts.alias("class_counts"),
        F.transform("items", lambda x: F.struct(x["label"], x["conf"], x["bbox_xyxy"], x["extra"])).alias("objects"),
    )


def _overlap_share(a: Column, b: Column) -> Column:
    """Intersection of two boxes over their union; 0 where both have no area."""
    width = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    height = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda box: F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))
    shared = width * height
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def suppressed(detections: DataFrame, keys: list[str], ident: str, *, min_conf: float = 0.25, iou: float = 0.7, limit: int = 300) -> DataFrame:
    """keys, label, ``ident`` and conf of the detections that stay (F8): of a frame's boxes of one label in order of falling
    confidence (ties: the smaller ``ident``), those that overlap no kept one by more than ``iou``; then the first ``limit`` of a frame.

    ``keys`` name a frame, whose boxes of one label are gathered and compared inside the JVM. Boxes without a
    confidence, an end or a frame are left out; null labels count as ""."""
    box = F.struct((-F.col("conf")).alias("order"), col(ident).alias("ident"), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    whole = detections.where(F.col("conf") >= min_conf).dropna(subset=[*keys, "x1", "y1", "x2", "y2"]).withColumn("label", F.coalesce("label", F.lit("")))
    boxes = whole.groupBy(*(col(k) for k in keys), "label").agg(F.array_sort(F.collect_list(box)).alias("_b"))
    kept = F.aggregate(
        "_b",
        F.slice("_b", 1, 0),
        lambda out, b: F.when(F.exists(out, lambda o: _overlap_share(o, b) > iou), out).otherwise(F.concat(out, F.array(b))),
    )
    rows = boxes.select(*keys, "label", F.explode(kept).alias("_k")).select(*keys, "label", F.col("_k.ident").alias(ident), (-F.col("_k.order")).alias("conf"))
    return top_per_group(rows, keys, [F.col("conf").desc(), col(ident)], limit).drop("rank")


def ocr_rows(detections: DataFrame, *, min_conf: float = 0.85) -> DataFrame:
    """OCR detections above a confidence with their normal text and box.

    Columns: video_id, det_id, frame_ts, conf, text, bbox. Rows whose label
    isn't ``text`` (any case, outer space ignored) or whose text has less than
    two characters after normalisation are left out. The confidence filter
    comes first and reaches the scan.
    """
    said = json_field(F.col("extra"), "$.text")
    rows = detections.where((F.col("conf") >= min_conf) & (F.lower(F.trim("label")) == "text") & F.col("frame_ts").isNotNull())
    return rows.select(
        "video_id", "det_id", "frame_ts", "conf", normal_text(said).alias("text"), F.array("x1", "y1", "x2", "y2").alias("bbox")
    ).where(F.length("text") > 1)


def word_index(rows: DataFrame, keys: list[str], at: str, ident: str, text: str = "text") -> DataFrame:
    """Inverted index (G4): keys, word, timestamps, occurrences (ts, ident, bbox, conf), count.

    One row per word with its times in order (ties by ``ident``); ``rows`` has bbox and conf. A frequent
    word's list is bounded by its video through ``keys``."""
    word = F.explode(F.split(col(text), r"\s+")).alias("word")
    words = rows.select(*(col(k) for k in keys), word, col(at).alias("ts"), col(ident).alias("ident"), "bbox", "conf").where("word != ''")
    every = F.array_sort(F.collect_list(F.struct("ts", "ident", "bbox", "conf")))
    return (
        words.groupBy(*keys, "word")
        .agg(every.alias("occurrences"))
        .select(*keys, "word", F.transform("occurrences", lambda x: x["ts"]).alias("timestamps"), "occurrences", F.size("occurrences").cast("bigint").alias("count"))
    )


def word_postings(rows: DataFrame, keys: list[str], at: str, ident: str, text: str = "text") -> DataFrame:
    """The same index as rows, for words that may be very frequent: keys, at, ident, bbox, conf, word."""
    kept = [*keys, at, ident, "bbox", "conf"]
    return rows.select(*(col(k) for k in kept), F.explode(F.split(col(text), r"\s+")).alias("word")).where("word != ''")
