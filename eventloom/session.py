"""Session settings and small planning helpers shared by the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "eventloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster's own settings stay as they are."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staged(df: DataFrame, path: str | None) -> DataFrame:
    """`df` written once and read back, for frames several later steps read; as it is without a path."""
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Checkpoint `df` in the shared folder that the session names.

    `fallback_dir` is used only where `spark.checkpoint.dir` is unset, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or fallback_dir
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()
