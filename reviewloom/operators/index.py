"""TF-IDF over long relations: postings (doc, term, tf, w) and terms (term, df, ctf, idf)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class IndexConfig:
    """Defaults of the retriever."""

    min_df: int = 2
    max_df: float = 0.95
    max_features: int | None = 60_000
    bigrams: bool = True
    sublinear: bool = True
    top_terms: int = 25
    kept_terms: int = 15


def row_terms(df: DataFrame, doc: str, order: str, toks: Column, bigrams: bool = True) -> DataFrame:
    """(doc, term, tf) of documents whose rows are joined in order: bigrams also across neighbouring rows.

    A document is never gathered: each row brings its own n-grams, and the one bigram over
    the border comes from the row before, found by a window over rows without their texts.
    """
    rows = df.select(F.col(doc).alias("doc"), F.col(order).alias("__o"), toks.alias("__t")).filter(F.size("__t") > 0)
    own = rows.select("doc", F.explode(text.ngrams(F.col("__t")) if bigrams else F.col("__t")).alias("term"))
    if bigrams:
        ends = rows.select("doc", "__o", F.element_at("__t", 1).alias("__a"), F.element_at("__t", -1).alias("__z"))
        before = F.lag("__z").over(Window.partitionBy("doc").orderBy("__o"))
        over = ends.withColumn("__b", before).filter("__b is not null").select("doc", F.concat_ws(" ", "__b", "__a").alias("term"))
        own = own.unionByName(over)
    return own.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def fit(tf: DataFrame, config: IndexConfig = IndexConfig(), n_docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, terms) of (doc, term, tf): kept terms, smooth idf, unit length documents.

    n_docs: one row `n`, where documents without any term count as well.
    """
    total = n_docs if n_docs is not None else tf.agg(F.count_distinct("doc").alias("n"))
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).crossJoin(F.broadcast(total.select(F.col("n").alias("__n"))))
    terms = terms.filter((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * F.col("__n")))
    terms = terms.select("term", "df", "ctf", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))
    if config.max_features:
        terms = terms.orderBy(F.desc("ctf"), "term").limit(config.max_features)
    return weigh(tf, terms, config.sublinear), terms


def weigh(tf: DataFrame, terms: DataFrame, sublinear: bool = True) -> DataFrame:
    """Postings (doc, term, tf, w): tf-idf weights of the kept terms, documents of unit length."""
    w = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    weighted = tf.join(terms.select("term", "idf"), "term").withColumn("__w", w * F.col("idf")).drop("idf")
    norm = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    return weighted.join(norm, "doc").select("doc", "term", "tf", (F.col("__w") / F.col("__norm")).alias("w"))


def top_terms(postings: DataFrame, k: int = 15) -> DataFrame:
    """The k heaviest terms of each document, with their rank; weights to six places, ties by term."""
    rounded = postings.withColumn("w", F.round("w", 6))
    best = Window.partitionBy("doc").orderBy(F.desc("w"), "term")
    return rounded.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def keywords(postings: DataFrame, k: int = 15) -> DataFrame:
    """A row a document: its top terms, plain and with scores, joined by commas."""
    t = top_terms(postings, k).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "w"))).alias("p"))
    return t.select("doc", F.array_join("p.term", ", ").alias("top_terms"), F.array_join(F.transform("p", lambda e: F.format_string("%s:%.4f", e["term"], e["w"])), ", ").alias("top_terms_scored"))


def save(postings: DataFrame, terms: DataFrame, path: str) -> None:
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    terms.write.mode("overwrite").parquet(f"{path}/terms")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
