"""Subtitle files as tables (S1, S2, K7). Two dialects that must not be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.functions.text import line_without_speaker, speaker_of_line
from cinetable.functions.timetext import srt_ms, srt_text
from cinetable.operators.positions import with_position
from cinetable.sources.files import in_few_tasks, listed_by_few_tasks

BLANK_LINE = r"\n[ \t\x0B\f\r]*\n\s*"
ARROW = r"^\s*(.*?)\s*-->\s*(.*?)\s*$"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path and content of text files, one row each. Many small files share a task."""
    with listed_by_few_tasks(spark):
        files = spark.read.text(list(paths), wholetext=True)
    return in_few_tasks(files.select(F.input_file_name().alias("path"), F.col("value").alias("content")), files)


def parse_subtitles(files: DataFrame, *, lenient: bool = False) -> DataFrame:
    """path, position, utt_id, start_sec, end_sec, speaker, text of the cues in file order.

    Strict (S1): blocks of one line are skipped; a first line that is no number
    makes the second the id by position; a ``[name]`` before the text becomes the
    speaker, else ``UNK``; cues without text are kept; a bad time raises.
    Lenient (S2): byte order marks are ignored; blocks without ``-->`` and cues
    without text are skipped; the speaker stays in the text; a bad time raises.
    A null or empty content has no cues.
    """
    content = F.regexp_replace(F.col("content"), "\r\n?", "\n")
    if lenient:
        content = F.regexp_replace(content, "﻿", "")
    blocks = files.select("path", F.posexplode(F.split(F.trim(content, F.lit("\n \t")), BLANK_LINE)).alias("_at", "_block"))
    lines = F.filter(F.split("_block", "\n"), lambda x: F.trim(x) != "")
    cues = blocks.select("path", "_at", lines.alias("_lines"))
    arrow_in = F.when(F.get("_lines", F.lit(0)).contains("-->"), 0).when(F.get("_lines", F.lit(1)).contains("-->"), 1)
    numbered = F.get("_lines", F.lit(0)).rlike(r"^\s*[+-]?\d+\s*$")
    if lenient:
        cues = cues.withColumn("_time", arrow_in).where("_time is not null")
    else:
        cues = cues.where(F.size("_lines") >= 2).withColumn("_time", F.when(numbered, 1).otherwise(0))
    times = F.get("_lines", F.col("_time"))
    said = F.slice("_lines", F.col("_time") + 2, F.greatest(F.size("_lines"), F.lit(1)))
    cues = cues.select(
        "path",
        F.when(numbered, F.trim(F.get("_lines", F.lit(0))).try_cast("bigint")).alias("_id"),
        F.regexp_extract(times, ARROW, 1).alias("_from"),
        F.regexp_extract(times, ARROW, 2).alias("_to"),
        F.transform(said, lambda line: F.trim(line)).alias("_said"),
        "_at",
    )
    cues = cues.select("path", "_id", srt_ms(F.col("_from")).alias("_s"), srt_ms(F.col("_to")).alias("_e"), "_said", "_at")
    if lenient:
        cues = cues.where(F.array_join("_said", "") != "")
        speaker, text = F.lit(None).cast("string"), F.array_join("_said", " ")
    else:
        head = F.coalesce(F.get("_said", F.lit(0)), F.lit(""))
        speaker = speaker_of_line(head)
        rest = F.slice("_said", 2, F.greatest(F.size("_said"), F.lit(1)))
        text = F.trim(F.array_join(F.concat(F.array(line_without_speaker(head)), rest), " "))
    return cues.select(
        "path",
        F.col("_at").alias("position"),
        F.coalesce("_id", F.col("_at").cast("bigint") + 1).alias("utt_id"),
        (F.col("_s") / 1000).alias("start_sec"),
        (F.col("_e") / 1000).alias("end_sec"),
        speaker.alias("speaker"),
        text.alias("text"),
    )


def subtitle_blocks(cues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, number and block of every cue: ``[speaker] text`` under its number and times (K7).

    Numbers run from 1 in ``order`` within ``keys``; a group is spread over tasks. A null speaker is ``UNK``, a null
    text counts as "", white space in a text becomes a space (a blank line would end the block)."""
    placed = with_position(cues, keys, order, "_n").withColumn("number", F.col("_n") + 1)
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    block = F.format_string(
        "%d\n%s --> %s\n[%s] %s\n", "number", srt_text(F.col("start_sec")), srt_text(F.col("end_sec")), F.coalesce("speaker", F.lit("UNK")), said
    )
    return placed.select(*keys, "number", block.alias("block"))


def write_subtitles(cues: DataFrame, key: str, order: list[str], folder: str) -> None:
    """The subtitles of every group in ``folder/key=.../`` (K7): blocks are sorted lines of text files, so no group is one row.

    A group is one file or, where it is large, several that are its text in the order of their names."""
    blocks = subtitle_blocks(cues, [key], order)
    blocks.repartitionByRange(key, "number").sortWithinPartitions(key, "number").select(key, "block").write.mode("overwrite").partitionBy(key).text(folder)
