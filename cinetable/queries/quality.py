"""Registered queries of the general data problems: intervals and faulty rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.operators.interval_union import continuous_periods
from cinetable.queries.tables import table
from cinetable.sources.faulty import parse_records

MAX_GAP_MS = 300_000


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods and gaps of utterances and OCR segments per video."""
    both = [
        table(spark, folder, name).select(F.lit(name).alias("src"), "video_id", "start_sec", "end_sec")
        for name in ("utterance", "ocr_segment")
    ]
    found = continuous_periods(
        both[0].unionByName(both[1]), ["src", "video_id"], "start_sec", "end_sec", max_gap_ms=MAX_GAP_MS
    )
    return found.select("src", "kind", "video_id", "start_ms", "end_ms")


def _parsed(spark: SparkSession, folder: str, name: str, key: str, kind: str) -> DataFrame:
    return parse_records(table(spark, folder, name), kind, keep=[key, "video_id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty detection lines and SRT blocks with the reason."""
    parts = [
        _parsed(spark, folder, name, key, kind)
        .where("reason is not null")
        .select(F.lit(name).alias("src"), F.col(key).alias("row_id"), "reason")
        for name, key, kind in (("det_line", "line_id", "detection"), ("srt_block", "block_id", "cue"))
    ]
    return parts[0].unionByName(parts[1])


def p6_detections(spark: SparkSession, folder: str) -> DataFrame:
    """The valid detection lines as typed rows."""
    return _parsed(spark, folder, "det_line", "line_id", "detection").where("reason is null").drop("reason", "raw_record")


def p6_cues(spark: SparkSession, folder: str) -> DataFrame:
    """The valid SRT blocks as typed rows."""
    return _parsed(spark, folder, "srt_block", "block_id", "cue").where("reason is null").drop("reason", "raw_record")


QUERIES = {
    "p1_found": p1_found,
    "p6_found": p6_found,
    "p6_detections": p6_detections,
    "p6_cues": p6_cues,
}

_P1_SQL = """
with raw as (
  select 'utterance' as src, video_id, start_sec, end_sec from utterance
  union all select 'ocr_segment', video_id, start_sec, end_sec from ocr_segment),
ms as (
  select src, video_id, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e
  from raw where start_sec is not null and end_sec is not null),
seen as (
  select *, max(e) over (partition by src, video_id order by s, e
                         rows between unbounded preceding and 1 preceding) as top
  from ms where e > s),
marked as (
  select *, sum(case when top is null or s > top then 1 else 0 end)
              over (partition by src, video_id order by s, e rows unbounded preceding) as grp
  from seen),
periods as (select src, video_id, min(s) as s, max(e) as e from marked group by src, video_id, grp),
followed as (select *, lead(s) over (partition by src, video_id order by s) as nxt from periods)
select src, 'period' as kind, video_id, s as start_ms, e as end_ms from followed
union all
select src, 'gap', video_id, e, nxt from followed where nxt is not null and nxt - e <= 300000
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n][^,\r\n]*|)'
_NUM = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*$"
_CLOCK = "[0-9]{2}:[0-5][0-9]:[0-5][0-9],[0-9]{3}"
_P6_SQL = rf"""
with d as (select line_id, regexp_replace(raw, '[\r\n]+$', '') as r from det_line),
-- a record is sound if it is fields and commas only; else a quoted field is open or goes on, or a line ends outside quotes
shaped as (
  select *, regexp_full_match(r, '{_FIELD}(?:,{_FIELD})*') as sound,
         regexp_full_match(r, '(?:{_FIELD}[,\r\n])*"(?:[^"]|"")*(?:"[^",\r\n][^\x00]*)?') as open_quote
  from d),
fields as (
  select *, case when sound then list_transform(regexp_extract_all(',' || r, ',({_FIELD})', 1),
           lambda f: case when f like '"%' then replace(substring(f, 2, length(f) - 2), '""', '"') else f end) end as f
  from shaped),
nums as (select *, list_transform([f[1], f[3], f[4], f[5], f[6], f[7]], lambda x: case when regexp_matches(x, '{_NUM}') then cast(trim(x) as double) end) as n
         from fields where sound and r <> '' and length(f) = 8),
det_bad as (
  select line_id, case when open_quote then 'quoting' when not sound or r = '' or length(f) <> 8 then 'columns' end as reason from fields
  union all
  select line_id, 'value' from nums
  where len(list_filter(n, lambda x: x is null)) > 0 or n[1] < 0 or n[2] < 0 or n[2] > 1 or n[5] < n[3] or n[6] < n[4] or trim(f[2]) = ''
     or (trim(f[8]) <> '' and not (json_valid(f[8]) and json_type(case when json_valid(f[8]) then f[8]::json end) = 'OBJECT'
         -- json_valid also takes trailing commas and NaN; strings are blanked before looking for them
         and not regexp_matches(regexp_replace(f[8], '"(?:[^"\\]|\\.)*"', '0', 'g'), ',\s*[}}\]]|NaN|Inf')))),
b as (select block_id, regexp_replace(replace(ltrim(raw, chr(65279)), chr(13) || chr(10), chr(10)), '\s+$', '') as r from srt_block),
lines as (select *, string_split(r, chr(10)) as l from b),
headed as (select block_id, case when regexp_full_match(l[1], '\s*[+-]?[0-9]+\s*') then l[2:] else l end as l from lines),
srt_bad as (
  select block_id, case
    when coalesce(len(l), 0) < 2 or not contains(l[1], '-->') then 'columns'
    when regexp_matches(l[2], '^\s*\[') and not contains(l[2], ']') then 'quoting'
    when not regexp_full_match(l[1], '\s*{_CLOCK}\s*-->\s*{_CLOCK}\s*') then 'value'
    when regexp_extract(l[1], '^\s*({_CLOCK})', 1) > regexp_extract(l[1], '({_CLOCK})\s*$', 1) then 'value'
    when regexp_matches(array_to_string(l[2:], ' '), '[\x00-\x1f\x7f-\x{{9f}}\x{{fffd}}]') then 'value' end as reason
  from headed)
"""
_P6_FOUND_SQL = (
    _P6_SQL
    + """
select 'det_line' as src, line_id as row_id, reason from det_bad where reason is not null
union all select 'srt_block', block_id, reason from srt_bad where reason is not null
"""
)
_P6_DETECTIONS_SQL = (
    _P6_SQL
    + """
select line_id, video_id, n[1] as frame_ts, f[2] as label, n[2] as conf, n[3] as x1, n[4] as y1, n[5] as x2, n[6] as y2, f[8] as extra
from nums join det_line using (line_id) where line_id not in (select line_id from det_bad where reason is not null)
"""
)
_P6_CUES_SQL = (
    _P6_SQL
    + r"""
, good as (
  select block_id, video_id, case when regexp_full_match(lines.l[1], '\s*[+-]?[0-9]+\s*') then cast(trim(lines.l[1]) as bigint) end as cue_no,
         list_transform(regexp_extract_all(headed.l[1], '[0-9]+'), lambda x: cast(x as bigint)) as t,
         regexp_extract(headed.l[2], '^\s*\[([^\]]*)\]', 1) as named, regexp_full_match(headed.l[2], '\s*\[[^\]]*\].*') as has_name, headed.l[2] as head, headed.l[3:] as rest
  from headed join lines using (block_id) join srt_block using (block_id)
  where block_id not in (select block_id from srt_bad where reason is not null))
select block_id, video_id, cue_no, ((t[1] * 60 + t[2]) * 60 + t[3]) * 1000 + t[4] as start_ms, ((t[5] * 60 + t[6]) * 60 + t[7]) * 1000 + t[8] as end_ms,
       case when has_name then named end as speaker,
       array_to_string(list_filter(list_transform(list_prepend(case when has_name then regexp_replace(head, '^\s*\[[^\]]*\]\s*', '') else head end, rest), lambda x: trim(x)), lambda x: x <> ''), ' ') as text
from good
"""
)

SQL = {"p1_found": _P1_SQL, "p6_found": _P6_FOUND_SQL, "p6_detections": _P6_DETECTIONS_SQL, "p6_cues": _P6_CUES_SQL}
