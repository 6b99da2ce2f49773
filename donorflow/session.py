"""Session defaults, reliable checkpoints and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SIDE_BY_SIDE = 6  # calls whose jobs Spark is given at a time


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, skew joins."""
    builder = (
        SparkSession.builder.appName("donorflow")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session of one process may go without; a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="donorflow-")


def side_by_side(spark: SparkSession, call: Callable[[Any], Any], items: Iterable[Any], threads: int = SIDE_BY_SIDE) -> list:
    """call(item) of each item, in their order; the many small jobs of independent calls fill the cores together."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(call), list(items), chunksize=1)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/donorflow-{name}-{uuid.uuid4().hex}"
