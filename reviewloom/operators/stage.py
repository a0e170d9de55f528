"""A cut in the lineage of tables that several later steps read."""

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """The table written to the checkpoint folder of the session; without such a folder, kept in memory and on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
