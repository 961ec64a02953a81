"""Registered queries over document texts: tokens, containers, encodings, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.llm.containers import pack_documents
from cinetable.llm.encodings import repair_texts
from cinetable.llm.languages import MIN_CHARS, detect_languages, mislabelled, train, training_sample
from cinetable.llm.containers import CAPACITY
from cinetable.llm.tokens import decode_column, token_ids


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spoken_and_shown(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances and OCR events as one table of texts with their declared labels."""
    spoken = _table(spark, folder, "utterance").select(
        F.lit("utterance").alias("src"), "video_id", F.col("utt_id").alias("rec_id"), "text", F.col("lang").alias("label")
    )
    shown = _table(spark, folder, "ocr_event").select(
        F.lit("ocr_event").alias("src"), "video_id", F.col("event_id").alias("rec_id"), F.col("ocr_text").alias("text"), F.col("lang").alias("label")
    )
    return spoken.unionByName(shown)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose label is missing or wrong, or whose text mixes languages."""
    texts = _spoken_and_shown(spark, folder)
    model = train(training_sample(texts, "text", "label"))
    # the query asks for texts of at least this length only
    asked = texts.where(F.length("text") >= MIN_CHARS)
    found = mislabelled(detect_languages(asked, "text", model, with_stretches=False), "text", "label")
    return found.select("src", "video_id", "rec_id", F.col("languages").alias("langs")).distinct()


def p7_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its language, confidence and single-language stretches."""
    texts = _spoken_and_shown(spark, folder)
    model = train(training_sample(texts, "text", "label"))
    return detect_languages(texts.dropDuplicates(["src", "video_id", "rec_id"]), "text", model).drop("text")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids(_table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text from its token ids again."""
    return decode_column(token_ids(_table(spark, folder, "documents")), "ids")


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """What the containers must be: all documents whole in pieces, none overfull, a document cut only if it exceeds the capacity, well filled."""
    pieces = pack_documents(_table(spark, folder, "documents")).withColumn("tokens", F.col("piece_end") - F.col("piece_start"))
    used = pieces.groupBy("container").agg(F.sum("tokens").alias("used")).agg(
        F.coalesce(F.sum((F.col("used") > CAPACITY).cast("bigint")), F.lit(0).cast("bigint")).alias("overfull"),
        (F.sum("used") / (F.count("*") * CAPACITY) >= 0.95).alias("well_filled"),
    )
    whole = pieces.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("piece_end").alias("size")
    ).agg(
        F.count("*").alias("documents"),
        F.sum(((F.col("n") > 1) & (F.col("size") <= CAPACITY)).cast("bigint")).alias("needlessly_cut"),
        F.sum((F.col("tokens") != F.col("size")).cast("bigint")).alias("incomplete"),
    )
    names = ["documents", "needlessly_cut", "incomplete", "overfull"]
    both = whole.unionByName(used, allowMissingColumns=True)  # one row each
    return both.agg(*(F.max(n).alias(n) for n in names), F.max("well_filled").alias("well_filled"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be divided between containers."""
    return pack_documents(_table(spark, folder, "documents")).where("piece = 1").select("doc_id").distinct()


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their containers."""
    return pack_documents(_table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold characters garbled by a wrong encoding."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return repair_texts(documents, "text").where("is_garbled").select("doc_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents with the original text where it can be had."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return repair_texts(documents, "text").where("is_garbled").drop("is_garbled")


QUERIES = {
    "p7_found": p7_found,
    "p7_languages": p7_languages,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_fill": p9_fill,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
SQL: dict[str, str] = {
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_fill": "select count(*) as documents, 0::bigint as needlessly_cut, 0::bigint as incomplete, 0::bigint as overfull, true as well_filled from documents",
}
