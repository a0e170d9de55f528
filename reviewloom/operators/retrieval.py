"""Queries against a TF-IDF index: cosine top-k, rerank by recommendations, comparison, term search, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: A sum of products is compared and ranked to so many places, so that its order does not depend on the plan.
PLACES = 6


def query_terms(queries: DataFrame, query: str, toks: Column) -> DataFrame:
    """(query, term, tf): tokens and bigrams of each query text."""
    t = queries.select(F.col(query).alias("query"), toks.alias("__t")).select("query", F.explode(text.ngrams(F.col("__t"))).alias("term"))
    return t.groupBy("query", "term").agg(F.count("*").alias("tf"))


def vocabulary_report(qterms: DataFrame, terms: DataFrame) -> DataFrame:
    """Per query: distinct terms, those in the vocabulary (nnz), and the share that is not."""
    known = qterms.join(terms.select("term", F.lit(True).alias("known")), "term", "left")
    return known.groupBy("query").agg(F.count("*").alias("n_terms"), F.count("known").alias("nnz")).withColumn("oov_ratio", F.round(1 - F.col("nnz") / F.col("n_terms"), 6))


def query_vectors(qterms: DataFrame, terms: DataFrame, sublinear: bool = True) -> DataFrame:
    """(query, term, qw) of unit length; terms outside the vocabulary count for nothing."""
    w = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    v = qterms.join(terms.select("term", "idf"), "term").withColumn("__w", w * F.col("idf"))
    norm = v.groupBy("query").agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    return v.join(norm, "query").select("query", "term", (F.col("__w") / F.col("__norm")).alias("qw"))


def similarities(vectors: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, doc, sim) of all pairs that share a term."""
    return vectors.join(postings.select("doc", "term", "w"), "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("qw") * F.col("w")), PLACES).alias("sim"))


def top_k(sims: DataFrame, k: int = 10, docs: DataFrame | None = None) -> DataFrame:
    """The k most similar documents of each query, ties by document.

    docs: the documents' names; then queries with fewer matches are filled with documents of similarity 0.
    """
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "doc")
    if docs is not None:
        # a query lacks at most k rows, and of the documents it did not meet the first are wanted: the first k + matches are enough
        short = sims.groupBy("query").agg(F.count("*").alias("m")).filter(F.col("m") < k).select("query")
        first = docs.select("doc").orderBy("doc").limit(2 * k)
        fill = short.crossJoin(F.broadcast(first)).join(sims.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("sim", F.lit(0.0))
        sims = sims.select("query", "doc", "sim").unionByName(fill)
    return sims.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def evidence(pairs: DataFrame, terms: DataFrame, comments: DataFrame, doc: str, row: str, value: Column, rate: Column, threshold: float = 4.0) -> DataFrame:
    """Per (query, doc): comments that hold a term of the query as whole words, and how many of those recommend.

    terms: (query, term); row: the comments' key. The terms are in lower case and the comments are not changed: case counts.
    Texts are not repeated for the queries: a comment brings its distinct words and pairs of words, joined by document and term.
    """
    rows = comments.select(F.col(doc).alias("doc"), F.col(row).alias("__row"), F.coalesce(rate >= threshold, F.lit(False)).alias("__rec"), F.split(F.coalesce(value, F.lit("")), " ").alias("__t"))
    held = rows.select("doc", "__row", "__rec", F.explode(F.array_distinct(text.ngrams(F.col("__t")))).alias("term"))
    asked = pairs.select("query", "doc").join(terms.select("query", "term"), "query")
    met = held.join(asked, ["doc", "term"]).select("query", "doc", "__row", "__rec").distinct()
    return met.groupBy("query", "doc").agg(F.count("*").alias("q_support"), F.count_if("__rec").alias("q_recommend"))


def overall(comments: DataFrame, doc: str, rate: Column, threshold: float = 4.0) -> DataFrame:
    """Per doc: all its comments, and the percentage of them that recommend."""
    n = comments.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("overall_support"), F.count_if(F.coalesce(rate >= threshold, F.lit(False))).alias("__r"))
    return n.select("doc", "overall_support", F.round(100 * F.col("__r") / F.col("overall_support"), PLACES).alias("overall_recommend_pct"))


def rerank(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """final = sim * (recommend + 1) / (support + 2) * ln(1 + support): without support it is 0."""
    n, r = F.coalesce("q_support", F.lit(0)), F.coalesce("q_recommend", F.lit(0))
    out = pairs.drop("rank").join(found, ["query", "doc"], "left").withColumn("q_support", n).withColumn("q_recommend", r)
    out = out.withColumn("q_recommend_pct", F.when(F.col("q_support") > 0, F.round(100 * F.col("q_recommend") / F.col("q_support"), PLACES)).otherwise(0.0))
    out = out.withColumn("q_recommend_smooth", F.round((F.col("q_recommend") + 1) / (F.col("q_support") + 2), PLACES))
    out = out.withColumn("final_score", F.round(F.col("sim") * (F.col("q_recommend") + 1) / (F.col("q_support") + 2) * F.log1p("q_support"), PLACES))
    best = Window.partitionBy("query").orderBy(F.desc("final_score"), F.desc("sim"), F.desc("q_support"), "doc")
    return out.withColumn("rank", F.row_number().over(best))


def search(queries: DataFrame, query: str, toks: Column, postings: DataFrame, terms: DataFrame, k: int = 10, docs: DataFrame | None = None) -> DataFrame:
    """Top-k documents for a table of queries; queries without a known term have no rows."""
    return top_k(similarities(query_vectors(query_terms(queries, query, toks), terms), postings), k, docs)


def compare_documents(postings: DataFrame, a, b, top: int = 20) -> DataFrame:
    """The union of two documents' top terms with both weights, the larger first."""
    from .index import top_terms

    best = top_terms(postings.filter(F.col("doc").isin([a, b])), top)
    left = best.filter(F.col("doc") == a).select("term", F.col("w").alias("w_a"))
    right = best.filter(F.col("doc") == b).select("term", F.col("w").alias("w_b"))
    both = left.join(right, "term", "full_outer").select("term", F.coalesce("w_a", F.lit(0.0)).alias("w_a"), F.coalesce("w_b", F.lit(0.0)).alias("w_b"))
    return both.withColumn("w_max", F.greatest("w_a", "w_b"))


def term_search(postings: DataFrame, terms: DataFrame, term: str, top: int = 10) -> DataFrame:
    """The documents in which a term weighs most, with its idf."""
    return postings.filter(F.col("term") == term).join(terms.select("term", F.round("idf", 6).alias("idf")), "term").select("term", "idf", "doc", F.round("w", 6).alias("w")).orderBy(F.desc("w"), "doc").limit(top)


def suggest_terms(terms: DataFrame, part: str, top: int = 8) -> DataFrame:
    """Vocabulary terms that hold a string, most frequent first."""
    return terms.filter(F.col("term").contains(part)).orderBy(F.desc("df"), "term").limit(top)


def heaviest_documents(postings: DataFrame, top: int = 10) -> DataFrame:
    return postings.groupBy("doc").agg(F.round(F.sum("w"), 6).alias("mass")).orderBy(F.desc("mass"), "doc").limit(top)


def holdout(df: DataFrame, group: str, row: str, share: float = 0.2, seed: int = 42, min_rows: int = 5, max_queries: int = 50, truncate: bool = False) -> DataFrame:
    """Adds `part`: per group of at least `min_rows` rows, clamp(bround(share * n), 1, n - 1) are test rows, drawn by hash.

    truncate: floor(share * n) instead of the rounded one. At most `max_queries` test rows a group are queries ("test"); further ones are in neither part ("unused").
    """
    draw = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row).cast("string"))), row)
    n = F.count("*").over(Window.partitionBy(group))
    size = F.greatest(F.lit(1), F.least((F.floor(n * share) if truncate else F.bround(n * share, 0)).cast("int"), n - 1))
    out = df.withColumn("__n", n).withColumn("__size", size).withColumn("__rn", F.row_number().over(draw))
    part = F.when(F.col("__n") < min_rows, "train").when(F.col("__rn") > F.col("__size"), "train").when(F.col("__rn") <= max_queries, "test").otherwise("unused")
    return out.withColumn("part", part).drop("__n", "__size", "__rn")


def true_ranks(sims: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, rank): 1 + the documents more similar than the true one. queries: those with a known term; truth: (query, doc)."""
    true = queries.join(truth, "query").join(sims, ["query", "doc"], "left").select("query", F.coalesce("sim", F.lit(0.0)).alias("__true"))
    above = sims.join(true, "query").filter(F.col("sim") > F.col("__true")).groupBy("query").agg(F.count("*").alias("__above"))
    return true.join(above, "query", "left").select("query", (1 + F.coalesce("__above", F.lit(0))).alias("rank"))


def rank_metrics(ranks: DataFrame, *by: str, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    aggs = [F.count("*").alias("n_queries"), *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_at_{k}") for k in ks]]
    aggs += [F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.median("rank"), 6).alias("median_rank")]
    return ranks.groupBy(*by).agg(*aggs)


def suite_report(results: DataFrame, set_name: str = "query_set") -> DataFrame:
    """Overall (null set) and per set: queries, empty ones, those without a known term or any similarity, mean share unknown."""
    return results.rollup(set_name).agg(
        F.count("*").alias("n_queries"), F.count_if("is_empty").alias("n_empty"), F.count_if(F.col("nnz") == 0).alias("n_nnz0"),
        F.count_if(F.coalesce("top1_sim", F.lit(0.0)) == 0).alias("n_top1_sim0"), F.round(F.avg("oov_ratio"), 6).alias("mean_oov_ratio"),
    )


def variant_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query, of two variants' results (query, doc): how many documents both found, and each alone."""
    both = a.select("query", "doc", F.lit(1).alias("a")).join(b.select("query", "doc", F.lit(1).alias("b")), ["query", "doc"], "full_outer")
    one = lambda x, y: F.count_if(F.col(x).isNotNull() & F.col(y).isNull())
    return both.groupBy("query").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), one("a", "b").alias("n_only_a"), one("b", "a").alias("n_only_b"))
