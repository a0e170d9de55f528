"""Corpus preparation in five stages over `documents`: rules, line dedup, near-dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents; n_chars follows the text. Near-duplicates have a Jaccard similarity of 0.8 or more
of their sets of five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import materialize, table
from reviewloom.llm.linededup import dedup
from reviewloom.llm.neardups import survivors
from reviewloom.llm.packing import HarmonicPacker
from reviewloom.llm.pii import pseudonymize, run_key
from reviewloom.llm.quality import QualityRules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rules reject go."""
    return QualityRules().keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from later ones; all rows stay."""
    return dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, Jaccard 0.8 or more), the document with the smallest doc_id stays."""
    return survivors(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced, under the key of the session's setting or a fresh one for this run; all rows stay."""
    out = pseudonymize(docs, run_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: all rows are packed."""
    return HarmonicPacker().pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("packing", packing)]

#: SQL can express neither the token ids nor the components; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
