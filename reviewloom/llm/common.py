"""What the operators of this subpackage share: the shared folder, written tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable

#: A word is a run without ASCII white space (space and 0x09 to 0x0D).
WORD = r"[^\x20\x09-\x0D]+"
words = re.compile(WORD).findall


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster, whose
    machines would each write to a folder of their own, that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="reviewloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/reviewloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor, so that a lost
    executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text (null: empty), without the other columns."""
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
