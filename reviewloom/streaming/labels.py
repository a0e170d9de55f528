"""The resumable label log as a stream: stateless normalization, latest label by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.files import LOG, is_done, latest


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Valid records of a folder to which JSON-lines files are added."""
    return spark.readStream.schema(LOG).option("mode", "DROPMALFORMED").json(folder).filter(is_done())


def normalized(stream: DataFrame, c: str, out: str = "text_clean") -> DataFrame:
    """The batch normalization, unchanged, on a stream."""
    return stream.withColumn(out, text.normalize(F.col(c)))


def latest_sink(target: str):
    """A foreachBatch function that keeps a Parquet table of each item's latest record: folders by batch, so a retried batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    return latest(spark.read.parquet(target).drop("epoch"))
