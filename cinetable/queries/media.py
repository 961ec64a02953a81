"""Registered queries of the core operators over the media tables, with their SQL.

A row delivered twice is one record in every query: keys are made unique first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.functions import text as X
from cinetable.functions.jsontext import flatten_json
from cinetable.functions.timetext import srt_ms, srt_text, srt_text_of_day, srt_whole_seconds
from cinetable.operators.aggregates import by_frame, ocr_rows, word_index
from cinetable.operators.fulltext import lookup, match, postings
from cinetable.operators.islands import text_segments, with_islands
from cinetable.operators.joins import points_with_intervals, speakers_by_overlap, with_contents, with_neighbours
from cinetable.operators.positions import with_position
from cinetable.operators.retrieval import passages, timecodes
from cinetable.operators.spelling import corrections
from cinetable.operators.windows import first_distinct, frame_times, history_text, time_windows, top_per_group, trimmed_history
from cinetable.plans.columns import to_ms
from cinetable.queries.tables import table

KEYS = {
    "utterance": ["video_id", "utt_id"],
    "ocr_event": ["event_id"],
    "ocr_segment": ["seg_id"],
    "chunks": ["video_id", "chunk_id"],
    "detection": ["det_id"],
}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def once(spark: SparkSession, folder: str, name: str, *columns: str, where: Column | str | None = None) -> DataFrame:
    """A table with every record once; only the named columns (and the key) are read and moved.

    Copies of a record differ in their time of arrival only, so ``where`` is applied before they are made one."""
    rows = table(spark, folder, name)
    rows = rows if where is None else rows.where(where)
    wanted = [c for c in rows.columns if (c in columns or c in KEYS[name]) and c != "ingested_at"] if columns else [
        c for c in rows.columns if c != "ingested_at"
    ]
    return rows.select(*wanted).dropDuplicates(KEYS[name])


#: The same in SQL, as leading common table expressions.
WITH = """
with utt as (select distinct * exclude (ingested_at) from utterance),
ocr as (select distinct * exclude (ingested_at) from ocr_event),
seg as (select distinct * from ocr_segment),
chk as (select distinct * from chunks),
det as (select distinct * exclude (ingested_at) from detection)
"""


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = (WITH.rstrip() + sql) if sql.lstrip().startswith((",", "select")) else sql
        return function

    return add


@query(
    "interval_join_names",
    """,
intro as (select * from utt where text ilike '%my name is %' or text ilike '%i am %' or text ilike '%i''m %' or text ilike '%introduc%'),
names as (select * from ocr where ocr_text glob '[A-Z][A-Za-z]* [A-Z][A-Za-z]*')
select distinct names.video_id, ocr_text as candidate_name, ts as visual_ts, start_sec as speak_start, text as spoken_line
from names left join intro on names.video_id = intro.video_id and ts between start_sec - 5 and end_sec + 5
""",
)
def interval_join_names(spark: SparkSession, folder: str) -> DataFrame:
    """On-screen names near spoken introductions."""
    names = once(spark, folder, "ocr_event", "video_id", "ts", "ocr_text", where=X.looks_like_name(F.col("ocr_text")))
    introduction = X.any_like(F.col("text"), "my name is ", "i am ", "i'm ", "introduc")
    intro = once(spark, folder, "utterance", "start_sec", "end_sec", "text", where=introduction)
    near = points_with_intervals(
        names, intro, ["video_id"], ["event_id"], F.col("ts"), F.col("start_sec") - 5, F.col("end_sec") + 5, bucket=10.0
    )
    return near.select(
        "video_id",
        F.col("ocr_text").alias("candidate_name"),
        F.col("ts").alias("visual_ts"),
        F.col("start_sec").alias("speak_start"),
        F.col("text").alias("spoken_line"),
    ).distinct()


@query(
    "utterances_of_class",
    "select utt.video_id, start_sec, end_sec, text from utt join video using (video_id) where vclass = 'screen' order by utt.video_id, start_sec",
)
def utterances_of_class(spark: SparkSession, folder: str) -> DataFrame:
    """The utterances of screen recordings in order (F1, P2, O3): the equality filter reaches the scan of ``video``."""
    wanted = table(spark, folder, "video").where(F.col("vclass") == "screen").select("video_id")
    rows = once(spark, folder, "utterance", "start_sec", "end_sec", "text").join(wanted, "video_id", "left_semi")
    return rows.select("video_id", "start_sec", "end_sec", "text").orderBy("video_id", F.col("start_sec").asc_nulls_last())


@query("label_like", "select det_id, video_id, frame_ts as timestamp, label, conf from det where label ilike '%person%'")
def label_like(spark: SparkSession, folder: str) -> DataFrame:
    """Detections whose label contains a word in any case."""
    rows = once(spark, folder, "detection", "video_id", "frame_ts", "label", "conf", where=X.any_like(F.col("label"), "person"))
    return rows.select("det_id", "video_id", F.col("frame_ts").alias("timestamp"), "label", "conf")


@query(
    "first_detections",
    "select det_id, video_id, frame_ts as timestamp, label, conf from det order by frame_ts nulls last, det_id limit 10",
)
def first_detections(spark: SparkSession, folder: str) -> DataFrame:
    """The ten earliest detections (O3): a top-n without a full sort."""
    rows = table(spark, folder, "detection").select("det_id", "video_id", F.col("frame_ts").alias("timestamp"), "label", "conf")
    return first_distinct(rows, ["det_id"], [F.col("timestamp").asc_nulls_last(), F.col("det_id")], 10)


_SAID = "lower(trim(regexp_replace(case when json_valid(extra) then json_extract_string(extra, '$.text') end, '\\s+', ' ', 'g')))"
_OCR_ROWS = f""",
rows as (
  select video_id, det_id, frame_ts, conf, [x1, y1, x2, y2] as bbox, {_SAID} as text from det
  where conf >= 0.85 and lower(trim(label)) = 'text' and frame_ts is not null),
said as (select * from rows where length(text) > 1)
"""


@query("conf_filter", _OCR_ROWS + "select video_id, det_id, frame_ts, conf, text from said")
def conf_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Confident screen texts in normal form."""
    return _screen_texts(spark, folder).drop("bbox")


def _screen_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "detection").drop("ingested_at", "frame_idx")
    return ocr_rows(rows).dropDuplicates(["det_id"])


@query(
    "json_fields",
    """select det_id, j ->> '$.text' as ocr_text, j ->> '$.track' as track, j ->> '$.p.angle' as angle,
       coalesce(lower(label) = 'text' and (j ->> '$.text') is not null, false) as is_ocr
from (select det_id, label, case when json_valid(extra) then extra::json end as j from det)
""",
)
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the JSON column, null where it doesn't parse, and the OCR flag."""
    rows = flatten_json(once(spark, folder, "detection", "label", "extra"), "extra", paths=["text", "track", "p.angle"])
    text = F.col("`extra.text`")
    return rows.select(
        "det_id",
        text.alias("ocr_text"),
        F.col("`extra.track`").alias("track"),
        F.col("`extra.p.angle`").alias("angle"),
        F.coalesce((F.lower("label") == "text") & text.isNotNull(), F.lit(False)).alias("is_ocr"),
    )


@query(
    "event_numbers",
    "select det_id, video_id, row_number() over (partition by video_id order by frame_ts nulls first, det_id) as event_id from det",
)
def event_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Event ids 1, 2, ... per video in order of time."""
    rows = once(spark, folder, "detection", "video_id", "frame_ts")
    return with_position(rows, ["video_id"], ["frame_ts", "det_id"], "event_id").select(
        "det_id", "video_id", (F.col("event_id") + 1).alias("event_id")
    )


@query(
    "frame_sample",
    """, f as (select video_id, frame_idx, min(frame_ts) as pts from det group by all),
s as (select f.*, target_fps, cast(greatest(1, round_even(30.0 / target_fps, 0)) as int) as step from f join video using (video_id))
select video_id, frame_idx, frame_idx // step as sample_no, cast(round(coalesce(pts, frame_idx / 30.0) * 1000) as bigint) as ms
from s where frame_idx % step = 0
""",
)
def frame_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The frames that sampling 30 fps video at its class's rate keeps, with their times."""
    rates = table(spark, folder, "video").select("video_id", "target_fps")
    frames = table(spark, folder, "detection").groupBy("video_id", "frame_idx").agg(F.min("frame_ts").alias("pts_seconds"))
    kept = frame_times(frames.join(rates, "video_id"), target_fps=F.col("target_fps"), native_fps=30.0)
    return kept.select("video_id", "frame_idx", "sample_no", to_ms(F.col("ts")).alias("ms"))


@query(
    "frame_aggregate",
    """, items as (select * exclude (label), coalesce(label, '') as label from det where frame_idx is not null),
counts as (select video_id, frame_idx, string_agg(label || ':' || n, ';' order by label) as class_counts
           from (select video_id, frame_idx, label, count(*) as n from items group by all) group by all),
frames as (select video_id, frame_idx, count(*) as n_detections,
                  string_agg(label, ';' order by label, -coalesce(conf, -1), det_id) as labels,
                  first(frame_ts order by label, -coalesce(conf, -1), det_id) as time_seconds,
                  string_agg(label || ' ' || coalesce(cast(cast(round(conf * 1000000) as bigint) as varchar), '') || ' ' ||
                             array_to_string(list_transform([x1, y1, x2, y2], lambda v: cast(cast(round(v * 1000) as bigint) as varchar)), ',') || ' ' ||
                             coalesce(extra, ''), ';' order by label, -coalesce(conf, -1), det_id) as objects
           from items group by video_id, frame_idx)
select video_id, frame_idx, cast(n_detections as int) as n_detections, labels, class_counts, time_seconds, objects
from frames join counts using (video_id, frame_idx)
""",
)
def frame_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Labels, class counts, time and objects of every frame."""
    rows = once(spark, folder, "detection", "video_id", "frame_idx", "frame_ts", "label", "conf", "x1", "y1", "x2", "y2", "extra")
    counts = F.array_join(F.transform(F.map_entries("class_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
    thousandths = lambda box: F.array_join(F.transform(box, lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",")
    objects = F.transform(
        "objects",
        lambda o: F.concat_ws(
            " ", o["label"], F.coalesce(F.round(o["conf"] * 1_000_000).cast("bigint").cast("string"), F.lit("")), thousandths(o["bbox_xyxy"]), F.coalesce(o["extra"], F.lit(""))
        ),
    )
    return by_frame(rows, ["video_id"]).select(
        "video_id", "frame_idx", "n_detections", "labels", counts.alias("class_counts"), "time_seconds", F.array_join(objects, ";").alias("objects")
    )


@query(
    "word_index",
    _OCR_ROWS
    + """, words as (select video_id, frame_ts, det_id, conf, bbox, unnest(regexp_split_to_array(text, '\\s+')) as word from said)
select video_id, word, count(*) as count, min(frame_ts) as first_ts, max(frame_ts) as last_ts,
       string_agg(cast(cast(round(frame_ts * 1000) as bigint) as varchar), ',' order by frame_ts, det_id) as times,
       string_agg(det_id || ' ' || cast(round(conf * 1000000) as bigint) || ' ' ||
                  array_to_string(list_transform(bbox, lambda v: cast(cast(round(v * 1000) as bigint) as varchar)), ' '), ',' order by frame_ts, det_id) as occurrences
from words where word <> '' group by video_id, word
""",
)
def words_on_screen(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted index of each video's screen words."""
    found = word_index(_screen_texts(spark, folder), ["video_id"], "frame_ts", "det_id")
    times = F.array_join(F.transform("timestamps", lambda t: F.round(t * 1000).cast("bigint").cast("string")), ",")
    whole = lambda x, factor: F.round(x * factor).cast("bigint").cast("string")
    each = F.transform(
        "occurrences", lambda o: F.concat_ws(" ", o["ident"].cast("string"), whole(o["conf"], 1_000_000), F.array_join(F.transform(o["bbox"], lambda v: whole(v, 1000)), " "))
    )
    return found.select(
        "video_id", "word", "count", F.array_min("timestamps").alias("first_ts"), F.array_max("timestamps").alias("last_ts"), times.alias("times"),
        F.array_join(each, ",").alias("occurrences"),
    )


@query("text_segments")
def segments_on_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Sequential segments of each video's screen texts."""
    return text_segments(_screen_texts(spark, folder))


@query(
    "segment_totals",
    _OCR_ROWS + "select video_id, count(*) as frames, count(*) as boxes, min(frame_ts) as first_sec, max(frame_ts) as last_sec from said group by video_id",
)
def segment_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What the segments of a video hold together: every reading and box once."""
    return text_segments(_screen_texts(spark, folder)).groupBy("video_id").agg(
        F.sum("frames").alias("frames"), F.sum(F.size("bboxes").cast("bigint")).alias("boxes"), F.min("start_sec").alias("first_sec"), F.max("end_sec").alias("last_sec")
    )


_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"


@query(
    "time_windows",
    f""", e as (
  select video_id, utt_id, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as t, coalesce(text, '') as text
  from utt where start_sec is not null and end_sec is not null),
facts as (select video_id, arg_min(s, utt_id) as anchor, max(t) as top from e group by video_id),
wins as (
  select e.*, top, anchor, unnest(generate_series(greatest(0, (s - anchor) // 60000 - 1), (t - anchor) // 60000 + 1)) as n
  from e join facts using (video_id)),
hit as (
  select *, anchor + n * 60000 as t0 from wins
  where t > anchor + n * 60000 and s < least(anchor + (n + 1) * 60000, top) and anchor + n * 60000 < top)
select video_id, n as window_no, printf('win_%06d_%010d', n, t0) as chunk_id, t0 as start_ms, least(t0 + 60000, top) as end_ms,
       {_SRT.format('t0')} as start_srt, {_SRT.format('least(t0 + 60000, top)')} as end_srt,
       trim(string_agg(text, ' ' order by utt_id, s)) as text
from hit group by video_id, n, t0, top
""",
)
def windows_of_speech(spark: SparkSession, folder: str) -> DataFrame:
    """One-minute windows anchored at each video's first utterance."""
    entries = once(spark, folder, "utterance", "start_sec", "end_sec", "text").select(
        "video_id", "utt_id", to_ms(F.col("start_sec")).alias("start_ms"), to_ms(F.col("end_sec")).alias("end_ms"), "text"
    )
    return time_windows(entries, ["video_id"], "utt_id", window_ms=60_000)


_PLACED = """, placed as (select *, row_number() over (partition by video_id order by start_sec nulls first, chunk_id) - 1 as position from chk)"""


def _placed(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return with_position(once(spark, folder, "chunks", "start_sec", *columns), ["video_id"], ["start_sec", "chunk_id"])


@query(
    "context_frames",
    _PLACED
    + """
select h.video_id, h.chunk_id, h.position, n.position - h.position as offset, n.chunk_id as neighbour
from placed h join placed n on n.video_id = h.video_id and n.position between h.position - 3 and h.position + 3
where h.text ilike '%umbrella%'
""",
)
def context_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The three chunks before and after each hit."""
    chunks = _placed(spark, folder, "text")
    hits = chunks.where(X.any_like(F.col("text"), "umbrella")).select("video_id", "chunk_id", "position")
    around = with_neighbours(hits, chunks.select("video_id", "position", "chunk_id"), ["video_id"], before=3, after=3)
    return around.select(
        "video_id", "chunk_id", F.col("position").cast("bigint").alias("position"), F.col("offset").cast("bigint").alias("offset"), F.col("neighbour.chunk_id").alias("neighbour")
    )


@query(
    "passages",
    _PLACED
    + """
, near as (
  select h.video_id, h.position, h.start_srt, h.end_srt, n.position - h.position as off,
         trim('[' || n.start_srt || '–' || n.end_srt || '] ' || coalesce(n.text, '')) as line
  from placed h join placed n on n.video_id = h.video_id and n.position between h.position - 1 and h.position + 1)
select video_id as query, cast(position + 1 as int) as rank,
       '### Passage ' || (position + 1) || ' | Main: ' || start_srt || '–' || end_srt || chr(10) ||
       string_agg(line, chr(10) order by off <> 0, off) as block
from near group by video_id, position, start_srt, end_srt
""",
)
def rendered_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk as a passage with one neighbour on either side."""
    chunks = _placed(spark, folder, "text", "start_srt", "end_srt").withColumnRenamed("position", "index")
    hits = chunks.select(F.col("video_id").alias("query"), (F.col("index") + 1).cast("int").alias("rank"), "video_id", "index", "start_srt", "end_srt")
    return passages(hits, chunks.select("video_id", "index", "start_srt", "end_srt", "text"), keys=["video_id"], before=1, after=1)


@query(
    "speakers_by_overlap",
    """, s as (select seg_id, video_id, cast(round(start_sec * 1000) as bigint) as a, cast(round(end_sec * 1000) as bigint) as b from seg),
t as (select video_id, speaker, cast(round(start_sec * 1000) as bigint) as c, cast(round(end_sec * 1000) as bigint) as d from utt where speaker is not null),
sums as (
  select seg_id, s.video_id, speaker, sum(least(b, d) - greatest(a, c)) as shared, min(c) as first
  from s join t on s.video_id = t.video_id and a < d and c < b group by all),
best as (select * from sums qualify row_number() over (partition by video_id, seg_id order by shared desc, first, speaker) = 1)
select s.seg_id, s.video_id, coalesce(speaker, 'UNK') as speaker, coalesce(shared, 0)::bigint as overlap_ms
from s left join best using (seg_id, video_id)
""",
)
def segment_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """The speaker heard longest during each OCR segment."""
    segments = once(spark, folder, "ocr_segment", "video_id", "start_sec", "end_sec").select(
        "seg_id", "video_id", to_ms(F.col("start_sec")).alias("start_ms"), to_ms(F.col("end_sec")).alias("end_ms")
    )
    turns = once(spark, folder, "utterance", "start_sec", "end_sec", "speaker").where("speaker is not null").select(
        "video_id", to_ms(F.col("start_sec")).alias("turn_start_ms"), to_ms(F.col("end_sec")).alias("turn_end_ms"), "speaker"
    )
    return speakers_by_overlap(segments, turns, ["video_id"], "seg_id").select("seg_id", "video_id", "speaker", "overlap_ms")


_MESSAGES = """, m as (
  select video_id, utt_id, case when speaker ilike '%1%' then 'user' else 'assistant' end as role, trim(coalesce(text, ''), ' ') as content from utt),
recent as (select * from m qualify row_number() over (partition by video_id order by utt_id desc) <= 8)"""


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(spark, folder, "utterance", "speaker", "text")
    role = F.when(F.coalesce(F.col("speaker").ilike("%1%"), F.lit(False)), "user").otherwise("assistant")
    return rows.select("video_id", "utt_id", role.alias("role"), F.col("text").alias("content"))


@query(
    "history_messages",
    _MESSAGES
    + """, used as (select *, coalesce(sum(length(content)) over (partition by video_id order by utt_id rows between unbounded preceding and 1 preceding), 0) as u from recent)
select video_id, utt_id, role, substring(content, 1, cast(300 - u as int)) as content from used where u < 300
""",
)
def history_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each video's last eight utterances as messages within 300 characters."""
    return trimmed_history(_messages(spark, folder), ["video_id"], "utt_id", max_chars=300)


@query(
    "history_text",
    _MESSAGES
    + """, lines as (select *, case when role = 'user' then 'User: ' else 'Assistant: ' end || content as line from recent),
used as (select *, coalesce(sum(length(line)) over (partition by video_id order by utt_id rows between unbounded preceding and 1 preceding), 0) as u from lines)
select video_id, string_agg(line, chr(10) order by utt_id) as history from used where u < 300 group by video_id
""",
)
def history_as_text(spark: SparkSession, folder: str) -> DataFrame:
    """The same as one text, lines never cut."""
    return history_text(_messages(spark, folder), ["video_id"], "utt_id", max_chars=300)


@query(
    "top_per_frame",
    """, f as (select det_id, video_id, frame_idx, label, conf from det where frame_idx is not null and conf is not null)
select *, cast(row_number() over (partition by video_id, frame_idx order by conf desc, det_id) as int) as rank from f
qualify rank <= 3
""",
)
def top_per_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The three surest detections of every frame."""
    rows = once(spark, folder, "detection", "video_id", "frame_idx", "label", "conf").where("frame_idx is not null and conf is not null")
    return top_per_group(rows, ["video_id", "frame_idx"], [F.col("conf").desc(), F.col("det_id")], 3)


_TOKENS = "list_filter(regexp_split_to_array(trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_STOPS = "['" + "', '".join(X.STOP_WORDS) + "']"
_KEPT = f"list_filter({_TOKENS}, lambda w: length(w) > 1 and not list_contains({_STOPS}, w))"


@query("tokenize", f"select video_id, chunk_id, array_to_string({_TOKENS.format('text')}, ' ') as tokens from chk where text is not null")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    """The plain tokens of every chunk."""
    rows = once(spark, folder, "chunks", "text").where("text is not null")
    return rows.select("video_id", "chunk_id", F.array_join(X.tokens(F.col("text"), remove_stop_words=False), " ").alias("tokens"))


@query("stop_word_filter", f"select video_id, chunk_id, array_to_string({_KEPT.format('text')}, ' ') as tokens from chk where text is not null")
def stop_word_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of every chunk without stop words."""
    rows = once(spark, folder, "chunks", "text").where("text is not null")
    return rows.select("video_id", "chunk_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


_TERMS = "list_filter(regexp_split_to_array(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query("fts_match", f"select start_sec, text, video_id, utt_id from utt where list_has_all({_TERMS}, ['camera', 'badge'])")
def fts_match(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances that hold both words, by a scan."""
    rows = once(spark, folder, "utterance", "start_sec", "text", where=match(F.col("text"), "camera badge"))
    return rows.select("start_sec", "text", "video_id", "utt_id")


@query("fts_lookup", f"select video_id, utt_id from utt where list_has_all({_TERMS}, ['camera', 'badge'])")
def fts_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The same through the postings."""
    rows = once(spark, folder, "utterance", "text")
    return lookup(postings(rows, ["video_id", "utt_id"], "text"), ["video_id", "utt_id"], "camera badge")


@query(
    "fts_phrase",
    f"""select video_id, utt_id from utt
where contains(' ' || array_to_string({_TERMS}, ' ') || ' ', ' night shift ') or contains(' ' || array_to_string({_TERMS}, ' '), ' umbr')""",
)
def fts_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """A phrase or a prefix."""
    return once(spark, folder, "utterance", where=match(F.col("text"), '"night shift" OR umbr*')).select("video_id", "utt_id")


@query(
    "srt_format",
    f""", t as (select video_id, utt_id, start_sec, greatest(0, cast(round_even(start_sec * 1000, 0) as bigint)) as ms, cast(floor(start_sec * 1000) as bigint) as cut from utt)
select video_id, utt_id, {_SRT.format('ms')} as rounded,
       printf('%02d:%02d:%02d,%03d', (cut // 3600000) % 24, (cut // 60000) % 60, (cut // 1000) % 60, cut % 1000) as of_day
from t where start_sec is not null
""",
)
def srt_format(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds as subtitle time, rounded and cut."""
    rows = once(spark, folder, "utterance", "start_sec").where("start_sec is not null")
    return rows.select("video_id", "utt_id", srt_text(F.col("start_sec")).alias("rounded"), srt_text_of_day(F.col("start_sec")).alias("of_day"))


@query(
    "srt_parse",
    """, p as (select video_id, chunk_id, regexp_extract(start_srt, '^(\\d{2}):(\\d{2}):(\\d{2}),(\\d{3})$', ['h', 'm', 's', 'f']) as x from chk where start_srt is not null)
select video_id, chunk_id, ((x.h::bigint * 60 + x.m::bigint) * 60 + x.s::bigint) * 1000 + x.f::bigint as ms, (x.h::bigint * 60 + x.m::bigint) * 60 + x.s::bigint as whole from p
""",
)
def srt_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Subtitle time as milliseconds and whole seconds."""
    rows = once(spark, folder, "chunks", "start_srt").where("start_srt is not null")
    return rows.select("video_id", "chunk_id", srt_ms(F.col("start_srt")).alias("ms"), srt_whole_seconds(F.col("start_srt")).alias("whole"))


@query(
    "previews",
    """select doc_id, case when length(text) > 220 then substring(text, 1, 217) || '…' else text end as preview,
       case when coalesce(regexp_replace(source, '[^A-Za-z0-9_-]', '_', 'g'), '') = '' then 'video' else regexp_replace(source, '[^A-Za-z0-9_-]', '_', 'g') end as stem
from documents
""",
)
def previews(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut for display, and file-safe names."""
    return table(spark, folder, "documents").select("doc_id", X.ellipsis(F.col("text"), 220, 217).alias("preview"), X.safe_stem(F.col("source")).alias("stem"))


@query(
    "web_intent",
    """select video_id, utt_id, """
    + " or ".join(f"regexp_matches(lower(coalesce(text, '')), '{p}')" for p in X.WEB_PATTERNS)
    + " as wants_web from utt",
)
def web_intent(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that ask for a web search."""
    return once(spark, folder, "utterance", "text").select("video_id", "utt_id", X.wants_web(F.col("text")).alias("wants_web"))


@query(
    "json_in_text",
    """, b as (select det_id, nullif(regexp_extract('note: ' || extra, '(\\{.*\\})', 1, 's'), '') as blob from det)
select det_id, case when blob is not null and json_valid(blob) then blob end as found from b
""",
)
def json_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON object inside a longer text."""
    rows = once(spark, folder, "detection", "extra")
    return rows.select("det_id", X.json_object_in(F.concat(F.lit("note: "), F.col("extra"))).alias("found"))


@query(
    "speaker_prefix",
    """select video_id, utt_id, case when regexp_matches(text, '^\\[[^\\]\\n]*\\]') then regexp_extract(text, '^\\[(.*?)\\]', 1) else 'UNK' end as named,
       case when regexp_matches(text, '^\\[[^\\]\\n]*\\]') then regexp_extract(text, '^\\[[^\\]\\n]*\\]\\s*((?s:.*))$', 1) else text end as said
from utt
""",
)
def speaker_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """A name in brackets before the text."""
    rows = once(spark, folder, "utterance", "text")
    return rows.select("video_id", "utt_id", X.speaker_of_line(F.col("text")).alias("named"), X.line_without_speaker(F.col("text")).alias("said"))


@query(
    "left_join_contents",
    """, r as (select event_id as id, lang as title, video_id as url, case when event_id % 2 = 0 then ocr_text end as text from ocr),
j as (select r.id, coalesce(nullif(title, ''), nullif(url, ''), '(untitled)') as title, coalesce(url, '') as url,
             coalesce(nullif(trim(r.text, ' '), ''), trim(d.text, ' '), '') as t from r left join documents d on d.doc_id = r.id)
select id, title, url, case when length(t) > 800 then rtrim(substring(t, 1, 790), ' ') || '…' else t end as snippet from j
""",
)
def left_join_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Results with their own text or that of the content table."""
    found = once(spark, folder, "ocr_event", "video_id", "ocr_text", "lang").select(
        F.col("event_id").alias("id"), F.col("lang").alias("title"), F.col("video_id").alias("url"),
        F.when(F.col("event_id") % 2 == 0, F.col("ocr_text")).alias("text"),
    )
    contents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return with_contents(found, contents)


@query(
    "timecodes",
    _PLACED
    + """, labelled as (
  select video_id, position, start_srt, trim(start_srt || ' – ' || end_srt || ' · ' ||
         case when length(replace(coalesce(text, ''), chr(10), ' ')) > 100 then substring(replace(coalesce(text, ''), chr(10), ' '), 1, 97) || '…' else replace(coalesce(text, ''), chr(10), ' ') end, ' ') as label from placed)
select video_id as query, label,
       arg_max(cast(substring(start_srt, 1, 2) as bigint) * 3600 + cast(substring(start_srt, 4, 2) as bigint) * 60 + cast(substring(start_srt, 7, 2) as bigint), position) as start
from labelled where label is not null group by video_id, label
""",
)
def chunk_timecodes(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every chunk with their start."""
    hits = _placed(spark, folder, "text", "start_srt", "end_srt").withColumnsRenamed({"video_id": "query", "position": "rank"})
    return timecodes(hits).where("label is not null")


@query(
    "videos_with_outputs",
    """select video_id, vclass from video
where video_id in (select video_id from utt) and video_id not in (select video_id from det where lower(trim(label)) = 'umbrella' and video_id is not null)
""",
)
def videos_with_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Videos with a transcript but without a certain object."""
    videos = table(spark, folder, "video").select("video_id", "vclass")
    seen = table(spark, folder, "detection").where(F.lower(F.trim("label")) == "umbrella").select("video_id")
    return videos.join(table(spark, folder, "utterance").select("video_id"), "video_id", "left_semi").join(seen, "video_id", "left_anti")


@query("candidate_union", "select video_id from utt where text ilike '%badge%' union select video_id from seg where text ilike '%badge%'")
def candidate_union(spark: SparkSession, folder: str) -> DataFrame:
    """The union of two candidate sets (U-1, G9)."""
    parts = [table(spark, folder, n).where(X.any_like(F.col("text"), "badge")).select("video_id") for n in ("utterance", "ocr_segment")]
    return parts[0].union(parts[1]).distinct()


@query(
    "table_counts",
    """select 'utterance' as name, count(*) as n, max(end_sec) as last_sec from utt union all
select 'ocr_segment', count(*), max(end_sec) from seg union all select 'chunks', count(*), max(end_sec) from chk
""",
)
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts and greatest ends."""
    parts = [
        once(spark, folder, n, "end_sec").agg(F.count("*").alias("n"), F.max("end_sec").alias("last_sec")).select(F.lit(n).alias("name"), "n", "last_sec")
        for n in ("utterance", "ocr_segment", "chunks")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "spelling",
    _OCR_ROWS
    + """, strings as (select text as s from said union select unnest(regexp_split_to_array(text, '\\s+')) from said),
-- the function counts bytes, so letters beyond ASCII become capitals, which the lower-case strings don't have
near as (select s, term, cnt, damerau_levenshtein(translate(s, 'äöüßàâçéèêëîïôûùáíóúñ…–’œ', 'ABCDEFGHIJKLMNOPQRSTUVWXY'),
                                                  translate(term, 'äöüßàâçéèêëîïôûùáíóúñ…–’œ', 'ABCDEFGHIJKLMNOPQRSTUVWXY')) as edits
         from strings, freq_term where abs(length(s) - length(term)) <= 2),
best as (select * from near where edits <= 2 qualify row_number() over (partition by s order by edits, cnt desc, term) = 1)
select s as text, coalesce(term, s) as corrected, cast(edits as int) as edits from strings left join best using (s)
""",
)
def spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Screen texts and the words in them with their correction by the frequency dictionary."""
    texts = _screen_texts(spark, folder).select("text")
    words = texts.select(F.explode(F.split("text", r"\s+")).alias("text"))
    return corrections(texts.unionByName(words), "text", table(spark, folder, "freq_term"))


@query(
    "seen_periods",
    """, t as (select video_id, det_id, cast(round(frame_ts * 1000) as bigint) as ms from det where frame_ts is not null),
b as (select *, case when ms - lag(ms) over (partition by video_id order by ms, det_id) <= 5000 then 0 else 1 end as fresh from t),
i as (select *, sum(fresh) over (partition by video_id order by ms, det_id rows unbounded preceding) as island from b)
select video_id, min(ms) as start_ms, max(ms) as end_ms, count(*) as detections from i group by video_id, island
""",
)
def seen_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of a video in which something is detected at least every five seconds (islands of W3)."""
    rows = once(spark, folder, "detection", "video_id", "frame_ts", where="frame_ts is not null")
    timed = rows.select("video_id", "det_id", to_ms(F.col("frame_ts")).alias("ms"))
    return with_islands(timed, ["video_id"], "ms", "det_id", gap_ms=5_000).groupBy("video_id", "island").agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("detections")
    ).drop("island")
