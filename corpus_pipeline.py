"""From raw documents to token ids: language, exact and near duplicates, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their columns; the last
gives token ids. Every stage is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm.bpe import encode_documents
from eventloom.llm.common import table
from eventloom.llm.exact_dedup import drop_duplicates
from eventloom.llm.language_id import held_out, keep_identified, train
from eventloom.llm.mixing import mix, training_places
from eventloom.llm.near_dedup import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. Each of these has a likeliest language, so the model rejects none."""
    return keep_identified(docs, train(docs.filter(~held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 or more the one with the smallest id."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every reading, with their hash, that of the decoded text, and the place in training order."""
    return encode_documents(
        training_places(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        carried=("train_part", "train_row"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("bpe", tokens)]

#: Language models, MinHash components and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; a stage's table is removed once the next one is written."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="eventloom-pipeline-")
    folder = f"{folder}/{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read:
            _remove(spark, read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    return docs
