"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tidewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow).

    On a cluster the master and sizes come from spark-submit; ``master`` is for local runs.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate results, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none gets a scratch folder of its own; on a cluster a missing setting is an error, because
    a machine-local folder would lose the data together with the executor.
    """
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


# While a checkpoint is planned and run. Wide feature plans make the optimizer's inferred constraints explode, from which the job
# gains nothing; and what a checkpoint has shuffled is not read again once it is written.
CHECKPOINTING = {"spark.sql.constraintPropagation.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    before = {key: spark.conf.get(key) for key in CHECKPOINTING}
    try:
        for key, value in CHECKPOINTING.items():
            spark.conf.set(key, value)
        return df.select("*").checkpoint(eager=True)  # select: settings hold for frames made under them
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


CALENDAR_ROWS = 500_000  # broadcast a calendar-sized table up to so many rows


def calendar_sized(df: DataFrame) -> DataFrame:
    """A table with a few rows a day, written once and broadcast if its count allows it, so that what it is joined to by date stays where it is."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= CALENDAR_ROWS else kept


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by key over the session's full number of shuffle partitions.

    For compute-heavy groups on few bytes: a plain shuffle would be merged by size into very few
    tasks, a counted one is not.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
