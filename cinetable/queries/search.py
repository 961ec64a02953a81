"""Registered retrieval queries: every 50th row asks, all rows answer.

Texts are the transcript chunks, numbered in order of (video_id, chunk_id); the
text queries are the OCR segments and the vector queries the embeddings whose id
is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.operators import retrieval as R
from cinetable.operators.positions import with_position
from cinetable.queries.media import KEYS, WITH, _KEPT
from cinetable.queries.tables import table

TOP, FETCH = 10, 50


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").dropDuplicates(KEYS["chunks"])
    return with_position(rows.select("video_id", "chunk_id", "start_srt", "end_srt", "text"), [], ["video_id", "chunk_id"], "index")


def _text_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_segment").where("seg_id % 50 = 0").dropDuplicates(["seg_id"])
    return rows.select(F.col("seg_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("index"), F.col("embedding").alias("vector"))


def _vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _rounded(ranked: DataFrame) -> DataFrame:
    return ranked.select("query", F.col("index").cast("bigint").alias("index"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_TEXT = (
    WITH.rstrip()
    + f""",
numbered as (select row_number() over (order by video_id, chunk_id) - 1 as index, text from chk),
split as (select index, case when text is null then [] else {_KEPT.format('text')} end as t from numbered),
totals as (select count(*) as n, avg(length(t)) as avgdl from split),
posts as (select index, length(t) as dl, unnest(t) as term from split),
tf as (select index, dl, term, count(*) as tf from posts group by all),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, totals group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
asked as (select seg_id as query, unnest({_KEPT.format('text')}) as term from (select distinct seg_id, text from seg where seg_id % 50 = 0)),
times as (select query, term, count(*) as times from asked group by all),
scored as (
  select query, index, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from times join idf using (term) join tf using (term), totals group by query, index),
filled as (
  select q.query, numbered.index, coalesce(score, 0.0) as score
  from (select distinct seg_id as query from seg where seg_id % 50 = 0) q cross join numbered left join scored using (query, index)),
lex as (select *, row_number() over (partition by query order by score desc, index) as rank from filled)
"""
)
#: The same with ties decided on rounded scores, as the operator does; sums depend on the order of their parts.
_TEXT_ROUNDED = _TEXT.replace("order by score desc, index) as rank from filled", "order by round(score, 9) desc, index) as rank from filled")
_DENSE = """
dense_all as (
  select q.vec_id as query, d.vec_id as index, list_inner_product(q.embedding::double[], d.embedding::double[]) as score
  from embeddings q, embeddings d where q.vec_id % 50 = 0),
dense as (select *, row_number() over (partition by query order by score desc, index) as rank from dense_all)
"""


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 (R3, R4, G6, O4): the ten best chunks of every query."""
    lexical = R.build_lexical(_chunks(spark, folder), "index", "text")
    return _rounded(R.bm25_top(lexical, _text_queries(spark, folder), TOP))


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Exact inner-product search in blocks."""
    return _rounded(R.dense_top(_vectors(spark, folder), _vector_queries(spark, folder), TOP))


def _lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both ranked lists for questions that have a text and a vector: query v asks with segment v + 50."""
    lexical = R.build_lexical(_chunks(spark, folder), "index", "text")
    asked = _vector_queries(spark, folder)
    texts = _text_queries(spark, folder).withColumn("query_id", F.col("query_id") - 50)
    texts = texts.join(asked.select(F.col("query").alias("query_id")), "query_id")
    found = R.dense_top(_vectors(spark, folder), asked.join(texts.select(F.col("query_id").alias("query")), "query"), FETCH)
    return R.bm25_top(lexical, texts, FETCH), found


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Reciprocal rank fusion of both lists (R7, J5, U-1, O5)."""
    return _rounded(R.fuse_ranks(*_lists(spark, folder), TOP))


def weighted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted z-scores of both lists."""
    return _rounded(R.fuse_scores(*_lists(spark, folder), TOP))


def mmr_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Diverse ten of the fifty nearest vectors."""
    vectors, asked = _vectors(spark, folder), _vector_queries(spark, folder)
    near = R.dense_top(vectors, asked, FETCH).join(vectors, "index").join(asked.select("query", F.col("vector").alias("query_vector")), "query")
    return R.rerank_mmr(near, TOP)


def _length_match(queries, texts) -> list[float]:
    """A stand-in for a caller's cross-encoder: shared words over all words."""
    pairs = ((set((q or "").lower().split()), set((t or "").lower().split())) for q, t in zip(queries, texts))
    return [len(a & b) / max(1, len(a | b)) for a, b in pairs]


def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The whole search (R12, R9, J6): fusion, reranking by pairs, chunk columns; questions may lack the text or the vector."""
    chunks = _chunks(spark, folder)
    texts = _text_queries(spark, folder).withColumn("query_id", F.col("query_id") - 50)
    asked = texts.join(_vector_queries(spark, folder).withColumnRenamed("query", "query_id"), "query_id", "full_outer")
    lexical = R.build_lexical(chunks, "index", "text")
    hits = R.search(chunks, lexical, asked, _vectors(spark, folder), rerank="cross", scorer=_length_match)
    return hits.withColumn("score", F.round("score", 6))


def search_context(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunks of every text query as one context text."""
    chunks = _chunks(spark, folder)
    hits = R.search(chunks, R.build_lexical(chunks, "index", "text"), _text_queries(spark, folder), method="bm25", k=3)
    return R.context_text(R.passages(hits, chunks.select("index", "start_srt", "end_srt", "text"), before=1, after=1))


QUERIES = {
    "bm25_topk": bm25_topk,
    "dense_topk": dense_topk,
    "rrf_fusion": rrf_fusion,
    "weighted_fusion": weighted_fusion,
    "mmr_rerank": mmr_rerank,
    "search_hybrid": search_hybrid,
    "search_context": search_context,
}

_RANKED = "select query, index, round(score, 6) as score, cast(rank as int) as rank from {0} where rank <= 10"
_BOTH = (
    _TEXT
    + ","
    + _DENSE
    + """,
a as (select query - 50 as query, index, score, rank from lex where rank <= 50 and query - 50 in (select vec_id from embeddings where vec_id % 50 = 0)),
b as (select query, index, score, rank from dense where rank <= 50 and query + 50 in (select seg_id from seg where seg_id % 50 = 0)),
both_lists as (select coalesce(a.query, b.query) as query, coalesce(a.index, b.index) as index, a.score as s1, b.score as s2, a.rank as r1, b.rank as r2
               from a full join b on a.query = b.query and a.index = b.index)
"""
)
SQL = {
    "bm25_topk": _TEXT + _RANKED.format("lex"),
    "dense_topk": "with " + _DENSE.strip() + " " + _RANKED.format("dense"),
    "rrf_fusion": _BOTH
    + """, fused as (select query, index, 1.0::double / (60 + coalesce(r1, 10000)) + 1.0::double / (60 + coalesce(r2, 10000)) as score from both_lists),
ranked as (select *, row_number() over (partition by query order by score desc, index) as rank from fused)
"""
    + _RANKED.format("ranked"),
    "weighted_fusion": _BOTH
    + """, stats as (select query, avg(coalesce(s1, 0)) as m1, stddev_pop(coalesce(s1, 0)) as d1, avg(coalesce(s2, 0)) as m2, stddev_pop(coalesce(s2, 0)) as d2
                     from both_lists group by query),
fused as (select query, index, 0.5 * coalesce((s2 - m2) / (d2 + 1e-9), 0) + 0.5 * coalesce((s1 - m1) / (d1 + 1e-9), 0) as score from both_lists join stats using (query)),
ranked as (select *, row_number() over (partition by query order by score desc, index) as rank from fused)
"""
    + _RANKED.format("ranked"),
    "mmr_rerank": "with recursive "
    + _DENSE.strip()
    + """,
c as (select query, index, rank, score, embedding::double[] as v from dense join embeddings on vec_id = index where rank <= 50),
sims as materialized (select a.query, a.index as i, b.index as j, list_inner_product(a.v, b.v) as s from c a join c b using (query)),
picks as (
  select distinct query, 0 as step, []::bigint[] as chosen from c
  union all
  select query, step + 1, list_append(chosen, arg_max(index, {'value': value, 'first': -rank})) from (
    select p.query, p.step, p.chosen, c.index, c.rank, 0.7 * c.score - 0.3 * coalesce(max(s.s), 0) as value
    from picks p join c using (query) left join sims s on s.query = p.query and s.i = c.index and list_contains(p.chosen, s.j)
    where p.step < 10 and not list_contains(p.chosen, c.index) group by p.query, p.step, p.chosen, c.index, c.rank, c.score)
  group by query, step, chosen)
select query, unnest(chosen) as index, unnest(range(1, 11))::int as rank from picks where step = 10
""",
    "search_hybrid": _TEXT_ROUNDED
    + ","
    + _DENSE
    + """,
-- a question without a text has no lexical list
a as (select query - 50 as query, index, rank from lex where rank <= 50 and query in (select seg_id from seg where text is not null)),
b as (select query, index, rank from dense where rank <= 50),
fused as (select coalesce(a.query, b.query) as query, coalesce(a.index, b.index) as index,
                 1.0::double / (60 + coalesce(a.rank, 10000)) + 1.0::double / (60 + coalesce(b.rank, 10000)) as score
          from a full join b on a.query = b.query and a.index = b.index),
top as (select * from fused qualify row_number() over (partition by query order by score desc, index) <= 50),
held as (select row_number() over (order by video_id, chunk_id) - 1 as index, video_id, chunk_id, start_srt, end_srt, text from chk),
words as (
  select top.*, held.* exclude (index), list_distinct(list_filter(regexp_split_to_array(lower(coalesce(q.text, '')), '\\s+'), lambda w: w <> '')) as x,
         list_distinct(list_filter(regexp_split_to_array(lower(coalesce(held.text, '')), '\\s+'), lambda w: w <> '')) as y
  from top join held using (index) left join (select distinct seg_id - 50 as query, text from seg where seg_id % 50 = 0) q using (query)),
judged as (select *, length(list_intersect(x, y)) / greatest(1, length(list_distinct(x || y)))::double as shared from words),
placed as (select *, row_number() over (partition by query order by shared desc, index) as rank from judged)
select query, rank::int as rank, 'hybrid-rrf+cross' as method, index, video_id, chunk_id, start_srt, end_srt, text, round(score, 6) as score from placed where rank <= 8
""",
    "search_context": _TEXT_ROUNDED
    + """,
held as (select row_number() over (order by video_id, chunk_id) - 1 as index, start_srt, end_srt, text from chk),
near as (
  select t.query, t.rank, h.start_srt as f, h.end_srt as e, n.index - t.index as off, trim('[' || n.start_srt || '–' || n.end_srt || '] ' || coalesce(n.text, '')) as line
  from lex t join held h on h.index = t.index join held n on n.index between t.index - 1 and t.index + 1 where t.rank <= 3),
blocks as (select query, rank, '### Passage ' || rank || ' | Main: ' || f || '–' || e || chr(10) || string_agg(line, chr(10) order by off <> 0, off) as block
           from near group by query, rank, f, e)
select query, string_agg(block, chr(10) || chr(10) order by rank) as context from blocks group by query
""",
}
