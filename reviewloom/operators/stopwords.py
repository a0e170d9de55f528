"""Stopwords from the corpus, and the final list with reasons for what is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .profile import spread


def suggest(tokens: DataFrame, n_groups: int | DataFrame, min_df: int = 30, min_ratio: float = 0.60, min_entropy: float = 0.60, allow: list[str] = fixed.LATIN_ALLOWLIST) -> DataFrame:
    """Candidates with their measures: tokens (group, facet, token) that many groups hold, evenly over facets.

    n_groups: the number of groups, or a one-row table (n).
    """
    kept = tokens.filter(~F.col("token").isin(list(allow))) if allow else tokens
    out = spread(kept, "group")
    if isinstance(n_groups, DataFrame):
        out = out.crossJoin(F.broadcast(n_groups.select(F.col("n").alias("__n"))))
        ratio = F.col("doc_freq") / F.col("__n")
    else:
        ratio = F.col("doc_freq") / F.lit(n_groups)
    out = out.withColumn("doc_ratio", F.round(ratio, 6)).withColumn("entropy_norm", F.round("entropy_norm", 6))
    good = (F.col("doc_freq") >= min_df) & (F.col("doc_ratio") >= min_ratio) & (F.col("entropy_norm") >= min_entropy)
    return out.select("token", "doc_freq", "doc_ratio", "corpus_tf", "entropy_norm", good.alias("suggested"))


def finalize(candidates: DataFrame, seed: list[str] = fixed.MEDICAL_STOPWORDS, allow: list[str] = fixed.LATIN_ALLOWLIST, high_risk: list[str] = fixed.HIGH_RISK_FINALIZE) -> tuple[DataFrame, DataFrame]:
    """(final tokens, excluded tokens with their reason)."""
    t = F.col("token")
    reason = F.when(F.length(t) < 2, "too_short").when(t.isin(list(allow)), "latin_allowlist").when(t.isin(list(high_risk)), "high_risk_keep")
    marked = candidates.select("token").distinct().withColumn("reason", reason)
    base = candidates.sparkSession.createDataFrame([(x,) for x in seed], "token string")
    return marked.filter("reason is null").select("token").union(base).distinct(), marked.filter("reason is not null")


def document_frequencies(df: DataFrame, c, watched: list[str]) -> DataFrame:
    """(token, n, share): rows that hold each watched token as a whole word."""
    from ..functions.text import has_token

    one = df.agg(F.count("*").alias("__n"), *[F.count_if(has_token(c, t)).alias(f"c{i}") for i, t in enumerate(watched)])
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"c{i}").alias("n"), F.round(F.col(f"c{i}") / F.col("__n"), 6).alias("share")) for i, t in enumerate(watched)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
