"""Ranked retrieval: BM25, dense vectors, fusion, reranking, context.

Ranks are decided by score, then by the smaller index, so ties have one result.
The index parts are DataFrames (or Parquet) built once: words, lengths and
term weights. Queries are a table too; many are answered in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinetable.functions.text import tokens
from cinetable.operators.joins import with_neighbours
from cinetable.operators.windows import top_per_group
from cinetable.plans.columns import col
from cinetable.plans.lineage import materialise
from cinetable.sinks.store import write_json_lines

K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_K, MISSING_RANK = 60, 10_000


#: What of a set of questions is sent to all tasks at once; more is asked in several passes over the documents.
SENT_BYTES = 64 << 20
QUESTIONS_AT_ONCE = 256


@dataclass
class LexicalIndex:
    """``documents``: index, dl, terms (words in order). ``weights``: term, idf. ``avgdl``: mean length.

    ``chunks`` (index and their columns), ``vectors`` (index, vector) and ``meta`` (facts about the
    build) are stored beside them where given (S6, K8)."""

    documents: DataFrame
    weights: DataFrame
    avgdl: float
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    meta: dict[str, str] | None = None

    def write(self, folder: str) -> None:
        """Parquet of words, weights and vectors, JSON lines of chunks, JSON of the facts."""
        parts = {"documents": self.documents, "weights": self.weights, "vectors": self.vectors}
        for name, part in parts.items():
            if part is not None:
                part.write.mode("overwrite").parquet(f"{folder}/{name}")
        if self.chunks is not None:
            write_json_lines(self.chunks, f"{folder}/chunks")
        facts = [(self.avgdl, dict(self.meta or {}))]
        write_json_lines(self.documents.sparkSession.createDataFrame(facts, _META).coalesce(1), f"{folder}/meta")

    @classmethod
    def read(cls, spark: SparkSession, folder: str, *, chunks: T.StructType | str | None = None, vectors: bool = False) -> LexicalIndex:
        """``chunks`` is the schema of the stored chunks, if they are wanted."""
        facts = spark.read.schema(_META).json(f"{folder}/meta").first()
        return cls(
            spark.read.parquet(f"{folder}/documents"),
            spark.read.parquet(f"{folder}/weights"),
            facts["avgdl"],
            None if chunks is None else spark.read.schema(chunks).json(f"{folder}/chunks"),
            spark.read.parquet(f"{folder}/vectors") if vectors else None,
            facts["meta"],
        )

    @property
    def postings(self) -> DataFrame:
        """index, dl, term, tf."""
        return self.documents.select("index", "dl", F.explode("terms").alias("term")).groupBy("index", "dl", "term").agg(F.count("*").alias("tf"))


_META = "avgdl double, meta map<string, string>"


def build_lexical(docs: DataFrame, index: str, text: str, *, remove_stop_words: bool = True) -> LexicalIndex:
    """BM25 parts of a table of texts (R3, G6). Words and weights are written once, while the plan is built.

    idf is ln(N - df + 0.5) - ln(df + 0.5); a negative one is replaced by
    ``FLOOR`` times the mean idf of the vocabulary. Null texts count as empty."""
    words = F.coalesce(tokens(col(text), remove_stop_words=remove_stop_words), F.array().cast("array<string>"))
    whole = materialise(docs.select(col(index).alias("index"), words.alias("terms")).select("index", F.size("terms").alias("dl"), "terms"))
    totals = whole.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    spread = whole.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = materialise(spread.select("term", (F.log(totals["n"] - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))).alias("_raw")))
    mean = raw.agg(F.avg("_raw")).first()[0]
    floor = F.lit(None if mean is None else mean * FLOOR).cast("double")
    weights = raw.select("term", F.when(F.col("_raw") < 0, floor).otherwise(F.col("_raw")).alias("idf"))
    return LexicalIndex(whole, weights, totals["avgdl"] or 0.0)


def _asked(lexical: LexicalIndex, queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, term, weight: how often a question holds a word, times the word's idf."""
    words = queries.select(col(query).alias("query"), F.explode(tokens(col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    return words.join(lexical.weights, "term").select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))


def bm25_scores(lexical: LexicalIndex, queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, index, score of every document that holds a word of the query; repeated words count again.

    All of them: the result has a row for each such document, so a frequent word makes many. ``bm25_top`` doesn't."""
    tf, norm = F.col("tf"), (1 - B + B * F.col("dl") / F.lit(lexical.avgdl))
    gain = F.col("weight") * tf * (K1 + 1) / (tf + K1 * norm)
    matched = lexical.postings.join(_asked(lexical, queries, query, text), "term")
    return matched.select("query", "index", gain.alias("gain")).groupBy("query", "index").agg(F.sum("gain").alias("score"))


# --- the best k of all documents for many questions ----------------------------
#
# Questions go to the documents: a task keeps the best k of its own documents for every question,
# so what leaves it is bounded by questions x k, whatever words are frequent.


#: Decimals in which scores are compared: sums that differ only by the order of their parts are ties.
COMPARED = 9


class _Best:
    """The best ``k`` (score in ``COMPARED`` decimals, then smaller index) a question."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.scores = [np.empty(0)] * questions
        self.idents = [np.empty(0, np.int64)] * questions
        self.least = np.full(questions, -np.inf)

    def add(self, q: int, idents: np.ndarray, scores: np.ndarray) -> None:
        compared = np.round(scores, COMPARED)
        kept = np.flatnonzero(compared >= self.least[q])
        if len(kept) > self.k:
            part = compared[kept]
            kept = kept[part >= np.partition(part, -self.k)[-self.k]]  # ties included
        if not len(kept):
            return
        scores, idents = np.concatenate([self.scores[q], scores[kept]]), np.concatenate([self.idents[q], idents[kept]])
        compared = np.round(scores, COMPARED)
        order = np.lexsort((idents, -compared))[: self.k]
        self.scores[q], self.idents[q] = scores[order], idents[order]
        if len(order) == self.k:
            self.least[q] = compared[order[-1]]

    def batches(self, questions: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = [len(s) for s in self.scores]
        if sum(counts):
            columns = np.repeat(questions, counts), np.concatenate(self.idents), np.concatenate(self.scores)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "index", "score"])


_RANKED = "query bigint, index bigint, score double"


def _best_first() -> list[Column]:
    return [F.round("score", COMPARED).desc(), F.col("index").asc()]


def _passes(asked: DataFrame, size: Column, run: Callable[[pa.Table], DataFrame], k: int) -> DataFrame:
    """``run`` on the questions, in parts (by a hash of ``query``) of at most about ``SENT_BYTES``; then the best ``k`` of all.

    One small job counts the questions and one collects each part while the plan is built."""
    total = asked.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-int(total) // SENT_BYTES))
    mine = F.pmod(F.xxhash64("query"), F.lit(parts))
    found = reduce(DataFrame.unionByName, [run((asked.where(mine == n) if parts > 1 else asked).toArrow()) for n in range(parts)])
    return top_per_group(found, ["query"], _best_first(), k)


def bm25_top(lexical: LexicalIndex, queries: DataFrame, k: int, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, index, score, rank of the best ``k`` (R4, O4); query and index are whole numbers. Documents without a word
    of the query have score 0 and fill up the list in order of index. Scores are compared in ``COMPARED`` decimals.

    Documents stay where they are, words are never joined. A batch of documents is left out for a question
    whose words' greatest gains in it add up to less than its k-th best score so far, which is exact."""
    # among the 2k smallest indexes at least k are unmatched whenever fewer than k match
    spare = [row["index"] for row in lexical.documents.select("index").orderBy("index").limit(2 * k).collect()]
    asked = _asked(lexical, queries.select(col(query).cast("bigint").alias("query"), col(text).alias("text")), "query", "text")
    avgdl, spark = lexical.avgdl, queries.sparkSession

    def run(part: pa.Table) -> DataFrame:
        ids, q = np.unique(part["query"].to_numpy(), return_inverse=True)
        # in order of the words, so that a document's gains are added in the same order in every run
        words, term = np.unique(part["term"].to_numpy(), return_inverse=True)
        order = np.lexsort((q, term))
        term, q, weight = term[order], q[order], part["weight"].to_numpy()[order]
        places = np.searchsorted(term, np.arange(len(words) + 1))
        shared = spark.sparkContext.broadcast((ids, {w: n for n, w in enumerate(words.tolist())}, places, q, weight))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, numbers, places, q, weight = shared.value
            top = _Best(len(ids), k)
            for batch in batches:
                _score_words(batch, numbers, places, q, weight, avgdl, top)
            yield from top.batches(ids)

        return lexical.documents.select(F.col("index").cast("bigint").alias("index"), "dl", "terms").mapInArrow(best, _RANKED)

    some = F.array(*(F.lit(i) for i in spare)) if spare else F.array()
    empty = queries.select(col(query).cast("bigint").alias("query"), F.explode(some.cast("array<bigint>")).alias("index"), F.lit(0.0).alias("score"))
    # a document may come with its own score and as a spare: the former may be negative, so it is not the greater that counts
    found = _passes(asked, F.octet_length("term") + 16, run, k).withColumn("own", F.lit(True))
    both = found.drop("rank").unionByName(empty.withColumn("own", F.lit(False)))
    scored = both.groupBy("query", "index").agg(F.max_by("score", "own").alias("score"))
    return top_per_group(scored, ["query"], _best_first(), k)


def _score_words(batch: pa.RecordBatch, numbers: dict[str, int], places: np.ndarray, q: np.ndarray, weight: np.ndarray, avgdl: float, top: _Best) -> None:
    idents, lengths, words = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    coded = words.flatten().dictionary_encode()
    to_number = np.array([numbers.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    if not len(to_number) or not len(top.least):
        return
    term = to_number[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(idents)), lengths)[term >= 0]
    pair, tf = np.unique(term[term >= 0] * len(idents) + doc, return_counts=True)
    term, doc = np.divmod(pair, len(idents))
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / avgdl))
    present, starts = np.unique(term, return_index=True)
    ends = [*starts[1:], len(term)]
    # the most that a document of the batch can have for each question
    bound, matched = np.zeros(len(top.least)), np.zeros(len(top.least), dtype=bool)
    for t, a, b in zip(present, starts, ends):
        own = slice(places[t], places[t + 1])
        bound[q[own]] += np.maximum(weight[own] * gain[a:b].max(), 0)
        matched[q[own]] = True
    open_questions = np.flatnonzero(matched & (bound * (1 + 1e-9) + 1e-9 >= top.least))
    for at in range(0, len(open_questions), QUESTIONS_AT_ONCE):
        some = open_questions[at : at + QUESTIONS_AT_ONCE]
        row = np.full(len(top.least), -1)
        row[some] = np.arange(len(some))
        scores, holds = np.zeros((len(some), len(idents))), np.zeros((len(some), len(idents)), dtype=bool)
        for t, a, b in zip(present, starts, ends):
            own = slice(places[t], places[t + 1])
            asking = row[q[own]]
            cells = np.ix_(asking[asking >= 0], doc[a:b])
            scores[cells] += np.outer(weight[own][asking >= 0], gain[a:b])
            holds[cells] = True
        for n, question in enumerate(some):
            found = np.flatnonzero(holds[n])
            top.add(question, idents[found], scores[n, found])


def dense_top(
    vectors: DataFrame, queries: DataFrame, k: int, *, index: str = "index", vector: str = "vector", query: str = "query", query_vector: str = "vector"
) -> DataFrame:
    """query, index, score, rank of the ``k`` vectors with the greatest inner product.

    Exact, in double precision. Vectors stay where they are and are read as matrices from their Arrow
    buffers; a task's products with all questions are cut to the best ``k`` a question before they leave it. Vectors of
    another length than the query, and null vectors, ids or elements, are left out."""
    asked = queries.select(col(query).cast("bigint").alias("query"), col(query_vector).cast("array<double>").alias("vector")).where(
        "query is not null and vector is not null and not exists(vector, x -> x is null)"
    )
    held = vectors.select(col(index).cast("bigint").alias("index"), col(vector).alias("vector")).where(
        "index is not null and vector is not null and not exists(vector, x -> x is null)"
    )
    spark = queries.sparkSession

    def run(part: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(_by_length(part["query"].to_numpy(), part["vector"].combine_chunks()))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops = {length: _Best(len(ids), k) for length, (ids, _) in shared.value.items()}
            for batch in batches:
                for length, (idents, matrix) in _by_length(batch.column(0).to_numpy(), batch.column(1)).items():
                    if length not in tops:
                        continue
                    wanted = shared.value[length][1]
                    for at in range(0, len(wanted), QUESTIONS_AT_ONCE):
                        for n, scores in enumerate(wanted[at : at + QUESTIONS_AT_ONCE] @ matrix.T, at):
                            tops[length].add(n, idents, scores)
            for length, top in tops.items():
                yield from top.batches(shared.value[length][0])

        return held.mapInArrow(best, _RANKED)

    return _passes(asked, F.size("vector") * 8 + 8, run, k)


def _by_length(idents: np.ndarray, lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return {int(lengths[0]): (idents, flat.reshape(len(lengths), -1))} if lengths[0] else {}
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    out = {}
    for length in np.unique(lengths):
        if length:
            own = np.flatnonzero(lengths == length)
            out[int(length)] = (idents[own], flat[starts[own][:, None] + np.arange(length)])
    return out


def fuse_ranks(lexical: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion (R7, J5, U-1): query, index, score, rank. A list that lacks a document counts as rank 10000."""
    both = _both(lexical, dense)
    score = sum(1.0 / (RRF_K + F.coalesce(r, F.lit(MISSING_RANK))) for r in (F.col("_r1"), F.col("_r2")))
    return _fused(both.withColumn("score", score), k)


def fuse_scores(lexical: DataFrame, dense: DataFrame, k: int, *, alpha: float = 0.5) -> DataFrame:
    """Weighted z-scores (R8, G7, X21): alpha x dense + (1 - alpha) x lexical.

    A missing score is 0 in the mean and the deviation of its list but has z 0 itself."""
    both = _both(lexical, dense)
    # a query's rows are at most the two lists, so its window is bounded by their length
    own = Window.partitionBy("query")
    z = []
    for s in ("_s1", "_s2"):
        filled = F.coalesce(F.col(s), F.lit(0.0))
        z.append(F.coalesce((F.col(s) - F.avg(filled).over(own)) / (F.stddev_pop(filled).over(own) + 1e-9), F.lit(0.0)))
    return _fused(both.withColumn("score", alpha * z[1] + (1 - alpha) * z[0]), k)


def _both(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    one = lexical.select("query", "index", F.col("rank").alias("_r1"), F.col("score").alias("_s1"))
    two = dense.select("query", "index", F.col("rank").alias("_r2"), F.col("score").alias("_s2"))
    return one.join(two, ["query", "index"], "full_outer")


def _fused(scored: DataFrame, k: int) -> DataFrame:
    return top_per_group(scored.select("query", "index", "score"), ["query"], [F.col("score").desc(), F.col("index").asc()], k)


def rerank_by_pairs(hits: DataFrame, score: Callable[[Sequence[str], Sequence[str]], Sequence[float]], k: int) -> DataFrame:
    """Reranking by a caller's pair scorer (R10, U3): ``hits`` has query, query_text, index, text; adds rerank_score, new rank."""

    @F.pandas_udf(T.DoubleType())
    def scored(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(score(queries.tolist(), texts.tolist()), dtype="float64")

    judged = hits.drop("rank").withColumn("rerank_score", scored(F.col("query_text"), F.col("text")))
    return top_per_group(judged, ["query"], [F.col("rerank_score").desc(), F.col("index").asc()], k)


def mmr_order(query: np.ndarray, docs: np.ndarray, k: int, weight: float = 0.7) -> list[int]:
    """Positions in the order of maximal marginal relevance; all in their order if there are at most ``k``."""
    if len(docs) <= k:
        return list(range(len(docs)))
    relevance = docs @ query
    penalty = np.zeros(len(docs))
    nearest = np.full(len(docs), -np.inf)
    free = np.ones(len(docs), dtype=bool)
    chosen: list[int] = []
    while len(chosen) < k:
        value = np.where(free, weight * relevance - (1 - weight) * penalty, -np.inf)
        best = int(value.argmax())
        chosen.append(best)
        free[best] = False
        nearest = np.maximum(nearest, docs @ docs[best])
        penalty = nearest
    return chosen


def rerank_mmr(hits: DataFrame, k: int, *, weight: float = 0.7) -> DataFrame:
    """MMR over each query's hits (R11, U5): ``hits`` has query, query_vector, index, vector, rank; result query, index, rank.

    The hits of a query are at most the candidates fetched for it, so a group is bounded by that parameter."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "index"])
        docs = np.array(group["vector"].tolist(), dtype=float)
        order = mmr_order(np.array(group["query_vector"].iloc[0], dtype=float), docs, k, weight)
        picked = group.iloc[order]
        return pd.DataFrame({"query": picked["query"], "index": picked["index"], "rank": range(1, len(order) + 1)})

    narrow = hits.select(
        F.col("query").cast("bigint").alias("query"), "query_vector", F.col("index").cast("bigint").alias("index"), "vector", F.col("rank").cast("int").alias("rank")
    )
    return narrow.groupBy("query").applyInPandas(run, "query bigint, index bigint, rank int")


def hits_of(ranked: DataFrame, chunks: DataFrame, method: str) -> DataFrame:
    """Ranked indexes with their chunks (J6, R9): rank, method, index, chunk columns, score."""
    held = [c for c in chunks.columns if c != "index"]
    return ranked.join(chunks, "index").select("query", "rank", F.lit(method).alias("method"), "index", *(col(c) for c in held), "score")


def passages(hits: DataFrame, chunks: DataFrame, *, keys: Sequence[str] = (), before: int = 3, after: int = 3) -> DataFrame:
    """Context blocks (R13, W2, O6, G11): query, rank, block. The hit's own line first, then its neighbours in order.

    ``hits``: query, rank, keys, index, start_srt, end_srt; ``chunks``: keys, index, start_srt, end_srt, text.
    ``keys`` are what an index is counted in; without any it is one of all chunks."""
    centre = hits.select("query", "rank", *(col(k) for k in keys), F.col("index").alias("position"), F.col("start_srt").alias("_from"), F.col("end_srt").alias("_to"))
    around = with_neighbours(centre, chunks.withColumnRenamed("index", "position"), list(keys), before=before, after=after)
    line = F.trim(F.concat(F.lit("["), F.col("neighbour.start_srt"), F.lit("–"), F.col("neighbour.end_srt"), F.lit("] "), F.coalesce("neighbour.text", F.lit(""))))
    lines = F.array_sort(F.collect_list(F.struct((F.col("offset") != 0).alias("away"), F.col("offset"), line.alias("line"))))
    grouped = around.groupBy("query", "rank", "_from", "_to").agg(lines.alias("_lines"))
    head = F.concat(F.lit("### Passage "), F.col("rank").cast("string"), F.lit(" | Main: "), F.col("_from"), F.lit("–"), F.col("_to"))
    return grouped.select("query", "rank", F.concat(head, F.lit("\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")).alias("block"))


def context_text(blocks: DataFrame) -> DataFrame:
    """All blocks of a query as one text (G11): query, context."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy("query").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def search(
    chunks: DataFrame,
    lexical: LexicalIndex,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    *,
    method: str = "rrf",
    rerank: str | None = None,
    k: int = 8,
    overfetch: int = 50,
    alpha: float = 0.5,
    scorer: Callable | None = None,
) -> DataFrame:
    """Retrieval and reranking in one plan (R12): query, rank, method, chunk columns, score.

    ``queries``: query_id, text and, for vectors, vector. ``chunks``: index, text
    and more; ``vectors``: index, vector. ``method`` is ``bm25``, ``embed``,
    ``rrf`` or, like any other name, the weighted fusion; ``rerank`` is None,
    ``cross`` (with ``scorer``) or ``mmr``. Fusion cuts its lists at
    ``max(k, overfetch)``, which is part of the result, not only of the speed. A
    query without a text or without a vector is fused with an empty list."""
    fetch = max(k, overfetch)
    asked = queries.withColumnRenamed("query_id", "query")
    parts: dict[str, Callable[[], DataFrame]] = {
        "bm25": lambda: bm25_top(lexical, queries, fetch),
        "embed": lambda: dense_top(vectors, asked, fetch),
    }
    if method in parts:
        found, name = parts[method](), method
    else:
        fuse = fuse_ranks if method == "rrf" else lambda a, b, n: fuse_scores(a, b, n, alpha=alpha)
        lexical_hits = bm25_top(lexical, queries.where("text is not null"), fetch)
        found, name = fuse(lexical_hits, parts["embed"](), fetch), f"hybrid-{method}"
    if rerank == "cross":
        texts = asked.select("query", F.coalesce("text", F.lit("")).alias("query_text"))
        judged = rerank_by_pairs(found.join(chunks.select("index", "text"), "index").join(texts, "query"), scorer, k)
        return hits_of(judged.select("query", "index", "score", "rank"), chunks, f"{name}+cross")
    if rerank == "mmr":
        held = found.join(vectors.select("index", "vector"), "index").join(
            asked.select("query", F.col("vector").alias("query_vector")), "query"
        )
        picked = rerank_mmr(held, k).join(found.select("query", "index", "score"), ["query", "index"])
        return hits_of(picked, chunks, f"{name}+mmr")
    return hits_of(found.where(F.col("rank") <= k), chunks, name)


def timecodes(hits: DataFrame) -> DataFrame:
    """Labels of hits with their start in whole seconds; of equal labels the last rank's start counts (R14): query, label, start."""
    from cinetable.functions.text import ellipsis
    from cinetable.functions.timetext import srt_whole_seconds

    snippet = ellipsis(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), 100, 97)
    label = F.trim(F.concat(F.col("start_srt"), F.lit(" – "), F.col("end_srt"), F.lit(" · "), snippet))
    return hits.groupBy("query", label.alias("label")).agg(F.max_by(srt_whole_seconds(F.col("start_srt")), "rank").alias("start"))


