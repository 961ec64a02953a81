"""Lineage cuts that survive the loss of an executor.

``materialise`` writes a result once to the shared folder named by
``spark.checkpoint.dir``. It is used where several consumers need the *same*
evaluation of a plan, for instance after a sampled range partitioning, whose
bounds could differ between two evaluations. ``localCheckpoint`` is never used:
its only copy dies with the executor. Written data is removed when nothing refers to it any more
if the session was started with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names. A temporary one is used only where the whole
    application is one process (master ``local``) and none is set; elsewhere that is an error."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    alone = context.master == "local" or context.master.startswith("local[")
    if not shared and not alone:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cinetable-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of this application below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
