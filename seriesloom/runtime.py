"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import types

from pyspark.sql import DataFrame, SparkSession

#: Most rows of a table that is broadcast.
SMALL = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``. Where that setting is absent, a local
    session gets a folder of its own that goes when the program ends; a cluster gets an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|-cluster|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="seriesloom-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints``
    Spark deletes its files once the frame is no longer referenced."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = SMALL) -> bool:
    """Whether a table has at most so many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks."""
    return vars(sys.modules.setdefault("_seriesloom_worker", types.ModuleType("_seriesloom_worker")))
