"""Interfaces to what stays outside the engine and makes rows: media tools, recognisers, diarisation, detectors,
encoders, descriptions of clips, web search (S9, S13, S15-S18, S20, U1-U3, ST1, R5). Callers pass plain callables;
nothing here needs a network. Language models are in ``chat``."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinetable.operators.joins import with_contents
from cinetable.plans.lineage import materialise

DETECTIONS = "video_id string, frame_idx int, ts double, label string, conf double, x1 double, y1 double, x2 double, y2 double, extra string"
Detector = Callable[[Sequence[bytes], float], Sequence[dict]]


@dataclass(frozen=True)
class Pipeline:
    """What a class of video is sampled at and detected with."""

    fps: int
    detect: Detector | None = None


# Sampling rates of the four classes of video.
PIPELINES = {"screen": Pipeline(3), "sport": Pipeline(15), "nature": Pipeline(7), "cctv": Pipeline(7)}


def detect_frames(frames: DataFrame, detect: Detector, *, fps: float, batch: int = 64) -> DataFrame:
    """Detections of sampled frames (S17, ST1): ``frames`` has video_id, frame_idx, ts, image.

    ``detect`` gets up to ``batch`` images and the rate and returns dicts with
    ``frame`` (place in the batch), label, conf, box and extra. Times are the frames' own.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                rows = []
                for found in detect(some["image"].tolist(), fps):
                    frame = some.iloc[found["frame"]]
                    box = found.get("box", (None,) * 4)
                    rows.append((frame["video_id"], frame["frame_idx"], frame["ts"], found["label"], found["conf"], *box, json.dumps(found.get("extra") or {}, ensure_ascii=False)))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in DETECTIONS.split(", ")])

    return frames.select("video_id", "frame_idx", "ts", "image").mapInPandas(run, DETECTIONS)


def encode_texts(df: DataFrame, text: str, encode: Callable[[Sequence[str]], Sequence[Sequence[float]]], name: str = "vector") -> DataFrame:
    """A caller's encoder over Arrow batches, vectors at unit length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for vector in encode(texts.fillna("").tolist()):
                length = sum(x * x for x in vector) ** 0.5 or 1.0
                rows.append([float(x) / length for x in vector])
            yield pd.Series(rows)

    return df.withColumn(name, run(F.col(text)))


def recognised(audio: DataFrame, recognise: Callable[[bytes], Sequence[tuple[float, float, str]]]) -> DataFrame:
    """A caller's speech recogniser over ``audio`` (video_id, content): video_id, start_sec, end_sec, text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(v, *cue) for v, content in zip(part["video_id"], part["content"]) for cue in recognise(content)]
            yield pd.DataFrame(rows, columns=["video_id", "start_sec", "end_sec", "text"])

    return audio.select("video_id", "content").mapInPandas(run, "video_id string, start_sec double, end_sec double, text string")


def diarised(audio: DataFrame, diarise: Callable[[bytes], Sequence[tuple[float, float, str]]]) -> DataFrame:
    """A caller's diarisation over ``audio`` (video_id, content): video_id, turn_start_ms, turn_end_ms, speaker (S16), as
    ``joins.speakers_by_overlap`` takes them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(v, round(a * 1000), round(b * 1000), who) for v, content in zip(part["video_id"], part["content"]) for a, b, who in diarise(content)]
            yield pd.DataFrame(rows, columns=["video_id", "turn_start_ms", "turn_end_ms", "speaker"])

    return audio.select("video_id", "content").mapInPandas(run, "video_id string, turn_start_ms bigint, turn_end_ms bigint, speaker string")


def decoded_frames(files: DataFrame, decode: Callable[[bytes], Iterable[tuple[int, float | None, bytes]]], *, native_fps: float = 30.0, target_fps: float) -> DataFrame:
    """Sampled frames of media files (S9): ``files`` has video_id and content; ``decode`` gives number, time (or None) and image.

    Result: video_id, frame_idx, ts, image. Frames that sampling leaves out are dropped before they leave the decoder."""
    step = max(1, round(native_fps / target_fps))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for video, content in zip(part["video_id"], part["content"]):
                rows = []
                for number, at, image in decode(content):
                    if number % step == 0:
                        rows.append((video, number, number / native_fps if at is None else at, image))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "ts", "image"])
                        rows = []
                yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "ts", "image"])

    return files.select("video_id", "content").mapInPandas(run, "video_id string, frame_idx int, ts double, image binary")


def described_clips(clips: DataFrame, describe: Callable[[bytes, str], str], question: str) -> DataFrame:
    """All columns of ``clips`` but content, and a model's description of each."""
    ask = F.udf(lambda content: None if content is None else describe(bytes(content), question).strip(), T.StringType())
    return clips.withColumn("description", ask("content")).drop("content")


def processed(sources: DataFrame, column: str, tool: Callable[[str], str]) -> DataFrame:
    """A tool (download, conversion) over paths or addresses (S13): all columns, result and error of each; one failure stops no other."""

    @F.udf("result string, error string")
    def run(source: str | None) -> tuple[str | None, str | None]:
        try:
            return (None, "no source") if source is None else (tool(source), None)
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    return sources.withColumn("_made", run(F.col(column))).select("*", "_made.result", "_made.error").drop("_made")


# Formats of the external tools.
DOWNLOAD = ["yt-dlp", "-f", "bv*+ba/b", "--merge-output-format", "mp4", "-o"]
TO_WAV = {"video": ["-vn", "-acodec", "pcm_s16le", "-ar", "44100", "-ac", "2"], "audio": []}


def download_command(address: str, folder: str) -> list[str]:
    """The download of a web video as one MP4 file named by its id."""
    return [*DOWNLOAD, f"{folder}/%(id)s.%(ext)s", address]


def wav_command(source: str, target: str, kind: str = "video") -> list[str]:
    """The conversion of a video's sound, or of an audio file, to WAV."""
    return ["ffmpeg", "-y", "-i", source, *TO_WAV[kind], target]


def web_results(queries: DataFrame, search: Callable[[str], Sequence[dict]], contents: Callable[[Sequence[str]], Sequence[dict]]) -> DataFrame:
    """Results of a caller's web search with the best text there is (S18, J7): query, id, title, url, snippet.

    ``queries`` has query. ``search`` gives dicts with id, title, url, text; ``contents`` the texts of ids. A query is searched once."""
    found = "query string, id string, title string, url string, text string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(q, *(hit.get(k) for k in ("id", "title", "url", "text"))) for q in part["query"] for hit in search(q)]
            yield pd.DataFrame(rows, columns=["query", "id", "title", "url", "text"])

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(c["id"], c.get("text")) for c in contents(part["id"].tolist())], columns=["id", "text"])

    hits = materialise(queries.select("query").where("query is not null").distinct().mapInPandas(run, found))
    texts = hits.where("id is not null").select("id").distinct().mapInPandas(fetch, "id string, text string")
    return with_contents(hits, texts, keep=["query"])
