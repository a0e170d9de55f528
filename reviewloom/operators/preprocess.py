"""From raw comments to the retriever's input in one lineage: no table is stored between the steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels, text


def steps(df: DataFrame, c: str = "text") -> DataFrame:
    """Adds text_step01 to text_step04 and, for each, whether it changed the text and left it empty."""
    out, before = df, c
    for i, f in enumerate((text.char_normalize, text.pre_clean, text.persian_style, text.deglue), 1):
        name = f"text_step{i:02}"
        out = out.withColumn(name, f(F.col(before))).withColumn(f"changed_{i:02}", F.col(name) != F.col(before)).withColumn(f"empty_{i:02}", text.is_blank(F.col(name)))
        before = name
    return out


def tokenized(df: DataFrame, stopwords: list[str], c: str = "text_step04") -> DataFrame:
    """Adds tok_all, tok_nostop, their counts, what was removed, and text_for_tfidf (all tokens where none are left)."""
    out = df.withColumn("tok_all", text.tokens(F.col(c)))
    out = out.withColumn("tok_nostop", text.without(F.col("tok_all"), stopwords))
    out = out.withColumn("tok_all_count", F.size("tok_all")).withColumn("tok_nostop_count", F.size("tok_nostop"))
    out = out.withColumn("empty_tok_all", F.col("tok_all_count") == 0).withColumn("empty_tok_nostop", F.col("tok_nostop_count") == 0)
    out = out.withColumn("stopword_removed_tokens", F.greatest(F.lit(0), F.col("tok_all_count") - F.col("tok_nostop_count")))
    out = out.withColumn("stopword_removed_ratio", F.try_divide("stopword_removed_tokens", "tok_all_count"))
    return out.withColumn("text_for_tfidf", F.concat_ws(" ", F.when(F.col("empty_tok_nostop"), F.col("tok_all")).otherwise(F.col("tok_nostop"))))


def medical(df: DataFrame, stopwords: list[str] = fixed.MEDICAL_STOPWORDS, bigrams=fixed.MEDICAL_BIGRAMS, allow: list[str] = fixed.LATIN_ALLOWLIST, keep: list[str] = fixed.HIGH_RISK_LIBRARY) -> DataFrame:
    """Adds the medical variant of text_for_tfidf, and how many and which tokens it lacks. Words in `keep` are never dropped alone."""
    stop = [s for s in stopwords if s not in set(keep) and s not in set(allow) and len(s) > 1]
    out = df.withColumn("__t", F.filter(F.split("text_for_tfidf", " "), lambda t: t != ""))
    kept, removed = text.greedy_stop_filter(F.col("__t"), stop, bigrams, allow)
    out = out.withColumn("text_for_tfidf_medical", F.concat_ws(" ", kept)).withColumn("__r", removed)
    return out.withColumn("medical_removed_token_count", F.size("__r")).withColumn("medical_removed_tokens_sample", text.removed_sample(F.col("__r"))).drop("__t", "__r")


def retriever_input(df: DataFrame, label: Column, c: str = "text", stopwords: list[str] = ()) -> DataFrame:
    """All steps, with the placeholder flag; rows that are placeholders or blank are not for an index."""
    out = medical(tokenized(steps(df, c), list(stopwords)))
    return out.withColumn("is_placeholder_negative", labels.placeholder(label, F.col(c))).withColumn("for_index", ~F.col("is_placeholder_negative") & ~text.is_blank(F.col("text_for_tfidf")))


def query_tokens(df: DataFrame, c: str, stopwords: list[str] = (), variant: str = "medical") -> DataFrame:
    """Adds `tokens` of a query text: by the same functions as the corpus."""
    out = tokenized(df.withColumn("__q", text.normalize(F.col(c))), list(stopwords), "__q")
    name = "text_for_tfidf"
    if variant == "medical":
        out, name = medical(out), "text_for_tfidf_medical"
    return out.withColumn("tokens", F.filter(F.split(F.lower(name), " "), lambda t: t != "")).select(*df.columns, "tokens")
