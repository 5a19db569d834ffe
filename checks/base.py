"""Registry of queries and their SQL, and a scratch folder for queries that write tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}

AS_OF = "2024-01-20"
NOW = "2024-01-20 12:00:00"
SITE = "https://site.example"


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables hold zoneless times; the SQL reads them as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a narrow table dealt out evenly, for costly work on each that would else follow the table's few files."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scratch(spark: SparkSession) -> str:
    """A fresh folder for tables a query writes, beside the checkpoints of the cluster.

    Where none is named a local master gets a temporary folder; a cluster without a shared folder is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if shared is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='eventloom-')}/{uuid.uuid4().hex}"
