"""Registered round trips through the file sources and sinks: whole tables are written and read back.

Files go to the shared folder while the plan is built; the result reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.operators import retrieval as R
from cinetable.operators.aggregates import word_index
from cinetable.operators.fulltext import lookup
from cinetable.plans.columns import to_ms
from cinetable.plans.lineage import shared_folder
from cinetable.queries.media import _OCR_ROWS, _TERMS, WITH, _screen_texts, once
from cinetable.queries.quality import _P6_SQL
from cinetable.queries.search import _TEXT_ROUNDED, TOP, _chunks, _text_queries, _vectors
from cinetable.queries.tables import table
from cinetable.sinks.store import detections_csv, frames_csv, register, write_csv, write_json_lines, write_table, write_text_index
from cinetable.sources.detections import read_chunks_jsonl, read_detections, read_detections_with_faults
from cinetable.sources.transcripts import parse_subtitles, read_files, write_subtitles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name] = function
        SQL[name] = (WITH.rstrip() + sql) if sql.lstrip().startswith((",", "select")) else sql
        return function

    return add


def _of_path(key: str):
    return F.regexp_extract("path", rf"{key}=([^/]+)/", 1)


@query(
    "p6_file_records",
    _P6_SQL
    + """
select video_id, n[1] as frame_ts, f[2] as label, n[2] as conf, n[3] as x1, n[4] as y1, n[5] as x2, n[6] as y2, f[8] as extra
from nums join det_line using (line_id) where line_id not in (select line_id from det_bad where reason is not null)
""",
)
def p6_file_records(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records of CSV files that hold all detection lines, faulty ones among them: none is lost to a fault before it."""
    files = shared_folder(spark, "det_line")
    lines = table(spark, folder, "det_line").where("raw is not null").select("video_id", "line_id", F.regexp_replace("raw", r"[\r\n]+$", "").alias("raw"))
    ordered = lines.repartitionByRange("video_id", "line_id").sortWithinPartitions("video_id", "line_id")
    ordered.select("video_id", "raw").write.partitionBy("video_id").text(files)
    found = read_detections_with_faults(spark, files, header=False).where("reason is null")
    return found.select(_of_path("video_id").alias("video_id"), "frame_ts", "label", "conf", "x1", "y1", "x2", "y2", "extra")


_CUES = r""", cues as (
  select video_id, row_number() over (partition by video_id order by start_sec, utt_id) as n,
         greatest(0, cast(round_even(start_sec * 1000, 0) as bigint)) as start_ms, greatest(0, cast(round_even(end_sec * 1000, 0) as bigint)) as end_ms,
         trim('[' || coalesce(speaker, 'UNK') || '] ' || trim(regexp_replace(coalesce(text, ''), '[\s\x{a0}]+', ' ', 'g')), ' ') as line
  from utt where start_sec is not null and end_sec is not null)
"""


def subtitle_folder(spark: SparkSession, folder: str) -> str:
    """All utterances with times as subtitle files."""
    files = shared_folder(spark, "subtitles")
    cues = once(spark, folder, "utterance", "start_sec", "end_sec", "speaker", "text", where="start_sec is not null and end_sec is not null")
    write_subtitles(cues, "video_id", ["start_sec", "utt_id"], files)
    return files


def _cue_columns(cues: DataFrame) -> list:
    return [_of_path("video_id").alias("video_id"), "utt_id", to_ms(F.col("start_sec")).alias("start_ms"), to_ms(F.col("end_sec")).alias("end_ms")]


@query(
    "srt_strict",
    _CUES
    + r"""select video_id, n as utt_id, start_ms, end_ms, regexp_extract(line, '^\[(.*?)\]\s*(.*)$', 1) as speaker,
       trim(regexp_extract(line, '^\[(.*?)\]\s*(.*)$', 2), ' ') as text from cues""",
)
def srt_strict(spark: SparkSession, folder: str) -> DataFrame:
    """All utterances as subtitle files, read in the strict dialect."""
    cues = parse_subtitles(read_files(spark, subtitle_folder(spark, folder)))
    return cues.select(*_cue_columns(cues), "speaker", "text")


@query("srt_lenient", _CUES + "select video_id, n as utt_id, start_ms, end_ms, line as text from cues")
def srt_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """The same files in the lenient dialect, which leaves the speaker in the text."""
    cues = parse_subtitles(read_files(spark, subtitle_folder(spark, folder)), lenient=True)
    return cues.select(*_cue_columns(cues), "text")


@query(
    "detections_csv",
    """select frame_idx as frame_index, round(frame_ts, 3) as frame_ts, coalesce(label, '') as label, round(conf, 6) as conf, x1, y1, x2, y2, coalesce(extra, '') as extra
from det""",
)
def detections_file(spark: SparkSession, folder: str) -> DataFrame:
    """All detections as the tall CSV of the newest extractor, read back."""
    files = shared_folder(spark, "detections")
    write_csv(detections_csv(once(spark, folder, "detection")), files)
    back = read_detections(spark, files, "all")
    return back.select(
        F.col("frame_index").cast("int").alias("frame_index"), "frame_ts", F.coalesce("label", F.lit("")).alias("label"), "conf", "x1", "y1", "x2", "y2",
        F.coalesce("extra", F.lit("")).alias("extra"),
    )


@query(
    "frames_csv",
    """, items as (select *, coalesce(label, '') as l from det where frame_idx is not null),
counts as (select video_id, frame_idx, '{' || string_agg('"' || l || '":' || n, ',' order by l) || '}' as class_counts_json
           from (select video_id, frame_idx, l, count(*) as n from items group by all) group by all)
select video_id, frame_idx as frame_index, count(*)::int as n_detections, string_agg(l, ';' order by l, -coalesce(conf, -1), det_id) as labels, class_counts_json
from items join counts using (video_id, frame_idx) group by all
""",
)
def frames_file(spark: SparkSession, folder: str) -> DataFrame:
    """All frames as the CSV with JSON cells, read back (K5)."""
    files = shared_folder(spark, "frames")
    write_csv(frames_csv(once(spark, folder, "detection"), ["video_id"]), files)
    back = spark.read.csv(files, header=True, multiLine=True, quote='"', escape='"')
    return back.select(
        "video_id", F.col("frame_index").cast("int").alias("frame_index"), F.col("n_detections").cast("int").alias("n_detections"),
        F.coalesce("labels", F.lit("")).alias("labels"), "class_counts_json",
    )


@query("chunks_jsonl", "select chunk_id, start_sec, end_sec, start_srt, end_srt, text from chk")
def chunks_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """All transcript windows as JSON lines, read back."""
    files = shared_folder(spark, "chunks")
    write_json_lines(once(spark, folder, "chunks").drop("video_id"), files)
    return read_chunks_jsonl(spark, files)


@query(
    "words_jsonl",
    _OCR_ROWS
    + """, words as (select frame_ts, video_id, unnest(regexp_split_to_array(text, '\\s+')) as word from said)
select video_id, word, count(*) as count, sum(cast(round(frame_ts * 1000) as bigint))::bigint as ms from words where word <> '' group by all
""",
)
def words_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """The word index as JSON lines, read back with its times."""
    files = shared_folder(spark, "words")
    write_json_lines(word_index(_screen_texts(spark, folder), ["video_id"], "frame_ts", "det_id").select("video_id", "word", "timestamps", "count"), files)
    back = spark.read.schema("video_id string, word string, timestamps array<double>, count bigint").json(files)
    ms = F.aggregate("timestamps", F.lit(0).cast("bigint"), lambda total, t: total + F.round(t * 1000).cast("bigint"))
    return back.select("video_id", "word", "count", ms.alias("ms"))


@query(
    "store_views",
    "select video_id, count(*) as utterances, max(start_sec) as last_sec from utt where text ilike '%camera%' group by video_id",
)
def store_views(spark: SparkSession, folder: str) -> DataFrame:
    """The utterances stored by video and asked in SQL through a view."""
    root = shared_folder(spark, "store")
    write_table(once(spark, folder, "utterance"), root, "utterance", sort=("start_sec", "utt_id"))
    register(spark, root, "utterance")
    return spark.sql("select video_id, count(*) as utterances, max(start_sec) as last_sec from utterance where text ilike '%camera%' group by video_id")


@query("fts_join", f"select start_sec, text, video_id, utt_id from utt where list_has_all({_TERMS}, ['camera', 'badge'])")
def fts_join(spark: SparkSession, folder: str) -> DataFrame:
    """A stored full-text index joined with its table by key."""
    root = shared_folder(spark, "store")
    said, keys = once(spark, folder, "utterance", "start_sec", "text"), ["video_id", "utt_id"]
    write_text_index(said, keys, "text", root, "utterance")
    write_table(said, root, "utterance", sort=("utt_id",))
    hits = lookup(spark.read.parquet(f"{root}/utterance_fts"), keys, "camera badge")
    return spark.read.parquet(f"{root}/utterance").join(hits, keys).select("start_sec", "text", *keys)


@query(
    "stored_index",
    _TEXT_ROUNDED
    + """, chosen as (select row_number() over (order by video_id, chunk_id) - 1 as index, chunk_id, start_srt from chk)
select query, index, chunk_id, start_srt, round(score, 6) as score, cast(rank as int) as rank from lex join chosen using (index) where rank <= 10
""",
)
def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """A search through an index that was stored and loaded with its chunks, vectors and facts."""
    root, chunks = shared_folder(spark, "index"), _chunks(spark, folder)
    built = R.build_lexical(chunks, "index", "text")
    built.chunks, built.vectors, built.meta = chunks, _vectors(spark, folder), {"anchor": "first"}
    built.write(root)
    index = R.LexicalIndex.read(spark, root, chunks=chunks.schema, vectors=True)
    hits = R.hits_of(R.bm25_top(index, _text_queries(spark, folder), TOP), index.chunks, "bm25")
    return hits.select("query", "index", "chunk_id", "start_srt", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))
