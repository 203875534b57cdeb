"""Session defaults and the shared place for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hearthline", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC clock; `conf` overrides any setting."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # legacy multi-byte survey files need a charset outside the default allow-list
        "spark.sql.legacy.javaCharsets": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir` (or set on the context).

    Only a local session without one gets a temporary folder; a cluster session is refused.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hearthline-")
        sc.setCheckpointDir(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read on from there.

    Used where a later step depends on how rows were split into partitions, or where a loop
    would grow the plan.
    """
    folder, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `stable`, by way of a Parquet table: for loops that join what they made the round before.

    A checkpointed table keeps the size that its plan was expected to have, and joins multiply sizes round by round,
    until planning alone takes longer than the work; a table that is read has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
