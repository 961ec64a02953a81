"""Registered queries through the interfaces to outside models and tools, with plain functions in their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.operators.windows import rescaled
from cinetable.plans.columns import to_ms
from cinetable.plans.lineage import shared_folder
from cinetable.queries.media import WITH, once
from cinetable.queries.stored import _CUES, subtitle_folder
from cinetable.queries.tables import table
from cinetable.sources import chat, files, models
from cinetable.streaming.ingest import ingest_subtitles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name] = function
        SQL[name] = (WITH.rstrip() + sql) if sql.lstrip().startswith((",", "select")) else sql
        return function

    return add


@query(
    "detected_frames",
    """, f as (select video_id, frame_idx, min(frame_ts) as ts, min(label) as label from det where frame_idx % 4 = 0 group by all)
select video_id, frame_idx, ts, coalesce(label, '') as label, length(coalesce(label, '')) / 100.0::double as conf, 0.0::double as x1, 1.0::double as x2, '{}' as extra from f
""",
)
def detected_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames through a detector in batches (S17, U1, ST1): here one that reads a label out of the image."""
    frames = table(spark, folder, "detection").where("frame_idx % 4 = 0").groupBy("video_id", "frame_idx").agg(
        F.min("frame_ts").alias("ts"), F.encode(F.coalesce(F.min("label"), F.lit("")), "utf-8").alias("image")
    )

    def detect(images, fps):
        return [{"frame": n, "label": bytes(x).decode(), "conf": len(bytes(x).decode()) / 100, "box": (0.0, 0.0, 1.0, 1.0)} for n, x in enumerate(images)]

    found = models.detect_frames(frames, detect, fps=models.PIPELINES["nature"].fps)
    return found.select("video_id", "frame_idx", "ts", "label", "conf", "x1", "x2", "extra")


@query(
    "decoded_frames",
    """, n as (select video_id, length(vclass) * 10 as n from video)
select video_id, i::int as frame_idx, cast(round(i / 30.0 * 1000) as bigint) as ms from n, lateral (select unnest(range(n)) as i) where i % 4 = 0
""",
)
def decoded_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Media files to sampled frames (S9, F6): here a file holds as many frames as its class's name tells."""
    media = table(spark, folder, "video").select("video_id", F.encode("vclass", "utf-8").alias("content"))
    frames = models.decoded_frames(media, lambda content: ((i, None, b"") for i in range(len(content) * 10)), target_fps=7)
    return frames.select("video_id", "frame_idx", to_ms(F.col("ts")).alias("ms"))


@query(
    "encoded_texts",
    """, v as (select video_id, utt_id, length(coalesce(text, ''))::double as a, 1.0::double as b from utt)
select video_id, utt_id, cast(round(a / sqrt(a * a + b * b) * 1000) as bigint) as x, cast(round(b / sqrt(a * a + b * b) * 1000) as bigint) as y from v
""",
)
def encoded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts through an encoder in batches, at unit length (R5, U2): here one that gives (length, 1)."""
    made = models.encode_texts(once(spark, folder, "utterance", "text"), "text", lambda texts: [[float(len(t)), 1.0] for t in texts])
    part = lambda n: F.round(F.get("vector", F.lit(n)) * 1000).cast("bigint")
    return made.select("video_id", "utt_id", part(0).alias("x"), part(1).alias("y"))


@query(
    "heard",
    """select video_id, 0.0::double as start_sec, length(vclass)::double as end_sec, vclass as text, 'S' || length(vclass) as speaker, length(vclass) * 1000::bigint as turn_end_ms from video
""",
)
def heard(spark: SparkSession, folder: str) -> DataFrame:
    """Sound through a recogniser and a diarisation (S15, S16): here they hear the class's name."""
    audio = table(spark, folder, "video").select("video_id", F.encode("vclass", "utf-8").alias("content"))
    cues = models.recognised(audio, lambda b: [(0.0, float(len(b)), bytes(b).decode())])
    turns = models.diarised(audio, lambda b: [(0.0, float(len(b)), f"S{len(b)}")])
    return cues.join(turns.select("video_id", "turn_end_ms", "speaker"), "video_id").select("video_id", "start_sec", "end_sec", "text", "speaker", "turn_end_ms")


@query("described", "select video_id, 'class ' || vclass as description, case when vclass = 'screen' then null else video_id || '.wav' end as result, vclass = 'screen' as failed from video")
def described(spark: SparkSession, folder: str) -> DataFrame:
    """Clips through a describing model and a converting tool that fails for some."""
    clips = table(spark, folder, "video").select("video_id", "vclass", F.encode("vclass", "utf-8").alias("content"))
    made = models.described_clips(clips, lambda content, question: f" {question} {content.decode()} ", "class")

    def convert(source: str) -> str:
        name, _, kind = source.rpartition("/")
        if kind == "screen":
            raise ValueError(kind)
        return models.wav_command(name, f"{name}.wav")[-1]

    done = models.processed(made.withColumn("source", F.concat_ws("/", "video_id", "vclass")), "source", convert)
    return done.select("video_id", "description", "result", F.col("error").isNotNull().alias("failed"))


@query(
    "searched_web",
    """, q as (select distinct vclass as query from video where vclass is not null),
h as (select query, query || '-' || i as id, case when i = 0 then query end as own, 'text of ' || query || '-' || i as other from q, range(3) t(i))
select query, id, '(untitled)' as title, '' as url, coalesce(own, other) as snippet from h
""",
)
def searched_web(spark: SparkSession, folder: str) -> DataFrame:
    """Questions through a web search and the contents of its results."""
    asked = table(spark, folder, "video").select(F.col("vclass").alias("query"))
    hits = lambda q: [{"id": f"{q}-{i}", "text": q if i == 0 else " "} for i in range(3)]
    return models.web_results(asked, hits, lambda ids: [{"id": i, "text": f"text of {i}"} for i in ids])


@query("answered", "select video_id, upper(vclass) as answer from video")
def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Questions through a language model, equal ones once and kept."""
    asked = table(spark, folder, "video").select("video_id", "vclass")
    kept = shared_folder(spark, "answers")
    ask = lambda messages: messages[-1]["content"].upper()
    chat.answered(asked.where("vclass = 'screen'"), "vclass", ask, folder=kept)
    return chat.answered(asked, "vclass", ask, folder=kept).select("video_id", "answer")


@query("found_files", "select video_id, 1::bigint as files, coalesce(vclass, '') = 'screen' as is_wav from video")
def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder by suffix, and which are sound by their first bytes."""
    root = shared_folder(spark, "media")
    content = F.when(F.col("vclass") == "screen", "RIFF and more").otherwise("no sound")
    table(spark, folder, "video").select("video_id", content.alias("value")).repartition("video_id").write.partitionBy("video_id").text(root)
    listed = files.list_videos(spark, root, ("txt",)).join(files.wav_files(spark, root), "path")
    video = F.regexp_extract("path", "video_id=([^/]+)/", 1)
    return listed.groupBy(video.alias("video_id")).agg(F.count("*").alias("files"), F.max("is_wav").alias("is_wav"))


@query(
    "rescaled_times",
    "select video_id, utt_id, cast(round(start_sec * 1.25 * 1000) as bigint) as start_ms, cast(round(end_sec * 1.25 * 1000) as bigint) as end_ms from utt",
)
def rescaled_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times of a recording that was played a quarter faster."""
    rows = rescaled(once(spark, folder, "utterance", "start_sec", "end_sec"), ["start_sec", "end_sec"], 1.25)
    return rows.select("video_id", "utt_id", to_ms(F.col("start_sec")).alias("start_ms"), to_ms(F.col("end_sec")).alias("end_ms"))


@query("streamed_cues", _CUES + "select count(*) as cues, sum(start_ms)::bigint as starts, sum(length(line))::bigint as letters from cues")
def streamed_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Subtitle files taken into the store as a stream (ST3): here each arrives as a file of its own."""
    source, root = subtitle_folder(spark, folder), shared_folder(spark, "stream")
    ingest_subtitles(files.session_for_small_files(spark), source, f"{root}/store", f"{root}/progress", glob="*.txt").awaitTermination()
    stored = spark.read.parquet(f"{root}/store/utterance")
    return stored.agg(F.count("*").alias("cues"), F.sum(to_ms(F.col("start_sec"))).alias("starts"), F.sum(F.length("text")).alias("letters"))
