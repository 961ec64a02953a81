"""Registered queries of relations and evidence: a graph of suppliers and parts, budgets, thresholds, box suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.operators import graph as G
from cinetable.operators.aggregates import suppressed
from cinetable.queries.media import WITH, once
from cinetable.queries.search import _DENSE, _vector_queries, _vectors
from cinetable.queries.tables import table
from cinetable.sources.chat import kept_by_answer

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name] = function
        SQL[name] = (WITH.rstrip() + sql) if sql.lstrip().startswith((",", "select")) else sql
        return function

    return add


def _supplies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return G.merged_relations(
        rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("b"), F.col("l_quantity").alias("weight"))
    )


_SUPPLIES = """
with r as (select 'P' || l_partkey as a, 'S' || l_suppkey as b, sum(l_quantity) as weight, count(*) as relations from lineitem group by all),
d as (select name, count(*) as degree from (select a as name from r union all select b from r) group by name)
"""


@query("edge_degrees", _SUPPLIES + "select r.a, r.b, weight, relations, x.degree + y.degree as degree from r join d x on x.name = r.a join d y on y.name = r.b")
def edge_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Merged relations of parts and suppliers with the degrees of their ends."""
    return G.edge_degrees(_supplies(spark, folder))


@query("one_hop", _SUPPLIES + "select b as name, a as neighbour from r where cast(substring(b, 2) as bigint) % 50 = 0")
def one_hop(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of every fiftieth supplier."""
    asked = table(spark, folder, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    return G.one_hop(asked, _supplies(spark, folder))


_ENTITIES = """, m as (select upper(trim(label)) as name, lang as kind, main as description, frame_idx % 7 as source_id from (
  select label, v.vclass as lang, v.main_lang as main, frame_idx from det join video v using (video_id)) where label is not null and trim(label) <> ''),
kinds as (select name, kind, count(*) as n from m where kind is not null group by all)
"""


@query(
    "merged_entities",
    _ENTITIES
    + """select name, (select kind from kinds k where k.name = m.name order by n desc, kind limit 1) as kind,
       string_agg(distinct description, '<SEP>' order by description) as description,
       string_agg(distinct cast(source_id as varchar), '<SEP>' order by cast(source_id as varchar)) as source_id, count(*) as mentions
from m group by name
""",
)
def merged_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Seen objects as entities: their commonest class of video, languages and a source number."""
    seen = once(spark, folder, "detection", "video_id", "label", "frame_idx").join(table(spark, folder, "video"), "video_id")
    return G.merged_entities(
        seen.select(F.col("label").alias("name"), F.col("vclass").alias("kind"), F.col("main_lang").alias("description"), (F.col("frame_idx") % 7).cast("string").alias("source_id"))
    )


@query(
    "within_budget",
    """, u as (select *, sum(length(coalesce(text, ''))) over (partition by video_id order by start_sec nulls first, chunk_id rows unbounded preceding) as used from chk)
select video_id, chunk_id from u where used <= 5000
""",
)
def within_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Each video's first windows within 5,000 characters."""
    rows = once(spark, folder, "chunks", "start_sec", "text").withColumn("size", F.length("text"))
    return G.within_budget(rows, ["video_id"], ["start_sec", "chunk_id"], "size", 5_000).select("video_id", "chunk_id")


@query("similar_above", "with " + _DENSE.strip() + " select query, index, cast(rank as int) as rank from dense where rank <= 10 and score >= 0.3")
def similar_above(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors that are near enough."""
    found = G.similar_above(_vectors(spark, folder), _vector_queries(spark, folder), 10, 0.3)
    return found.select("query", "index", F.col("rank").cast("int").alias("rank"))


@query(
    "kept_segments",
    """, f as (select seg_id, video_id, coalesce(text ilike '%camera%', false) as yes from seg)
select seg_id, video_id from f qualify yes or not bool_or(yes) over (partition by video_id)
""",
)
def kept_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each video's OCR segments with a yes to a question, all of a video without any (F13); the text stands in for the model's answer."""
    rows = once(spark, folder, "ocr_segment", "video_id", "text")
    said = rows.withColumn("answer", F.when(F.col("text").ilike("%camera%"), "Yes."))
    return kept_by_answer(said, ["video_id"], "answer").select("seg_id", "video_id")


@query(
    "segments_of_either",
    "select video_id, seg_id from seg where text ilike '%badge%' union select video_id, seg_id from seg where avg_conf >= 0.9",
)
def segments_of_either(spark: SparkSession, folder: str) -> DataFrame:
    """OCR segments found by their text or by their confidence, in order (U-4)."""
    by_text = table(spark, folder, "ocr_segment").where(F.col("text").ilike("%badge%"))
    return G.either(by_text, table(spark, folder, "ocr_segment").where("avg_conf >= 0.9"), ["video_id", "seg_id"])


@query(
    "evidence",
    """, n as (select video_id, '"' || video_id || '","' || coalesce(start_srt, '') || '","' || coalesce(end_srt, '') || '","' || replace(coalesce(text, ''), '"', '""') || '"' as line,
       row_number() over (partition by video_id order by start_sec nulls last, chunk_id) as n from chk)
select video_id, 'video_id,start_srt,end_srt,text' || chr(10) || string_agg(line, chr(10) order by n) as evidence from n where n <= 5 group by video_id
""",
)
def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Each video's first five windows as a CSV table for a prompt."""
    from cinetable.operators.windows import top_per_group

    rows = once(spark, folder, "chunks")
    first = top_per_group(rows, ["video_id"], [F.col("start_sec").asc_nulls_last(), F.col("chunk_id")], 5)
    return G.evidence_csv(first, ["video_id"], ["video_id", "start_srt", "end_srt", "text"], [F.col("rank")])


_IOU = "greatest(0, least(o.x2, x2) - greatest(o.x1, x1)) * greatest(0, least(o.y2, y2) - greatest(o.y1, y1))"


@query(
    "suppressed_boxes",
    WITH.replace("with ", "with recursive ", 1).rstrip()
    + f""", b as (select det_id, video_id, frame_idx, coalesce(label, '') as label, conf, x1, y1, x2, y2,
         row_number() over (partition by video_id, frame_idx, coalesce(label, '') order by conf desc, det_id) as r
  from det where conf >= 0.25 and video_id is not null and frame_idx is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null),
kept as (
  select video_id, frame_idx, label, r, [{{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as boxes from b where r = 1
  union all
  select b.video_id, b.frame_idx, b.label, b.r, case when len(list_filter(boxes, lambda o:
      ({_IOU}) > 0.7 * (greatest(0, o.x2 - o.x1) * greatest(0, o.y2 - o.y1) + greatest(0, b.x2 - b.x1) * greatest(0, b.y2 - b.y1) - ({_IOU})))) > 0
    then boxes else list_append(boxes, {{'id': det_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) end
  from kept join b on b.video_id = kept.video_id and b.frame_idx = kept.frame_idx and b.label = kept.label and b.r = kept.r + 1),
done as (select unnest(list_transform(boxes, lambda o: o.id)) as det_id from kept qualify row_number() over (partition by video_id, frame_idx, label order by r desc) = 1)
select b.video_id, b.frame_idx, b.label, b.det_id, b.conf from done join b using (det_id)
qualify row_number() over (partition by b.video_id, b.frame_idx order by b.conf desc, b.det_id) <= 300
""",
)
def suppressed_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Detections of every frame without boxes that overlap a surer one of their label (F8)."""
    rows = once(spark, folder, "detection", "video_id", "frame_idx", "label", "conf", "x1", "y1", "x2", "y2")
    return suppressed(rows, ["video_id", "frame_idx"], "det_id")
