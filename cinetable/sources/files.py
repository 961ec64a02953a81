"""Discovery of media files, outputs and indexes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = ("mp4", "mov", "mkv", "avi")
#: Tasks a core that list many folders or read many files; Spark starts up to 10,000 to list them, and one for every few small files.
TASKS_PER_CORE = 4
#: Files are read by more tasks where that many would have more bytes each.
TASK_BYTES = 64 << 20
#: What a file counts besides its bytes where files are dealt to the tasks of a stream (Spark: 4 MB).
OPEN_COST = 1 << 16
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _tasks(spark: SparkSession) -> int:
    return min(10_000, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


@contextmanager
def listed_by_few_tasks(spark: SparkSession) -> Iterator[None]:
    """What is read herein lists its folders by few tasks; the setting of the session is restored."""
    before = spark.conf.get(_LISTING, None)
    spark.conf.set(_LISTING, _tasks(spark))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTING)
        else:
            spark.conf.set(_LISTING, before)


def in_few_tasks(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows``, a projection of ``files`` as they were read, by few tasks without a shuffle."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.coalesce(max(_tasks(files.sparkSession), -(-size // TASK_BYTES)))


def session_for_small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that lists folders by few tasks and gives a task many small files: a stream asks
    its session for both as long as it runs."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_LISTING, _tasks(spark))
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    return own


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, modified and length of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def list_videos(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = MEDIA) -> DataFrame:
    """Video files by path."""
    return list_files(spark, folder).where(has_suffix(F.col("path"), *suffixes)).orderBy("path")


def has_suffix(path: Column, *suffixes: str) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin([s.lower() for s in suffixes])


def is_url(text: Column) -> Column:
    """Whether a text is a web address."""
    return text.rlike(r"(?i)^https?://")


def complete_outputs(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """Run folders ``<stem>_*`` that hold a transcript, newest first (S11, J9, O7): run, modified."""
    runs = list_files(spark, folder).withColumn("run", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    runs = runs.where(F.col("run").startswith(f"{stem}_"))
    with_transcript = runs.where(F.col("path").endswith("/transcript.srt")).select("run").distinct()
    return runs.join(with_transcript, "run", "left_semi").groupBy("run").agg(F.max("modified").alias("modified")).orderBy(F.desc("modified"), "run")


def latest_index(spark: SparkSession, folder: str) -> str | None:
    """The folder of the newest index."""
    found = list_files(spark, folder, "meta*").agg(F.max_by("path", "modified").alias("path")).first()
    return found["path"].rsplit("/", 1)[0] if found and found["path"] else None


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and is_wav, by the first four bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", (F.substring("content", 1, 4) == F.lit(b"RIFF")).alias("is_wav"))
