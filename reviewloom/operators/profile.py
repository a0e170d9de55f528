"""Profiles of tables: counts, shares, describe, missingness, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def value_counts(df: DataFrame, *keys: str, top: int | None = None, name: str = "n", share: bool = False) -> DataFrame:
    """Counts by key (null is a key), most frequent first, ties by key; share: of all rows."""
    out = df.groupBy(*keys).agg(F.count("*").alias(name))
    if share:  # a window over the grouped rows would gather them in one task
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias("__total")))).withColumn("share", F.round(F.col(name) / F.col("__total"), 6)).drop("__total")
    return out.orderBy(F.desc(name), *keys).limit(top) if top else out


def describe(df: DataFrame, value: Column, *by: str, points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """n, min, mean, max and exact linear percentiles of `value`, over all rows or by group."""
    v = value.cast("double")
    aggs = [F.count(v).alias("n"), F.round(F.min(v), 6).alias("min"), F.round(F.avg(v), 6).alias("mean"), F.round(F.max(v), 6).alias("max")]
    aggs += [F.round(F.percentile(v, F.lit(p)), 6).alias(f"p{round(p * 100):02d}") for p in points]
    return df.groupBy(*by).agg(*aggs)


def over_limits(df: DataFrame, value: Column, limits: tuple[int, ...] = (64, 128, 256, 384, 512), *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(value > t).alias(f"over_{t}") for t in limits])


def missingness(df: DataFrame, *columns: str) -> DataFrame:
    """(column, nulls, empties) in one pass over the table."""
    aggs = []
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"), F.count_if(F.col(c).cast("string") == "").alias(f"{c}__empty")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__null").alias("n_null"), F.col(f"{c}__empty").alias("n_empty")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def coverage(df: DataFrame, c: Column, patterns: dict[str, str] = fixed.AUDIT_PATTERNS) -> DataFrame:
    """How many rows each pattern occurs in."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(c.rlike(p if p.startswith("(?i)") else text.U + p)).alias(f"n_{name}") for name, p in patterns.items()])


def repeated_texts(df: DataFrame, c: Column, group: str, min_count: int = 2) -> DataFrame:
    """Texts by their key that occur at least `min_count` times, with the number of groups they occur in."""
    return df.groupBy(text.text_key(c).alias("text_key")).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups")).filter(F.col("n") >= min_count)


def duplicate_rows(df: DataFrame, key: Column) -> DataFrame:
    """Rows beyond the first of each key; null is one key."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


def bins(df: DataFrame, value: Column, edges: tuple[float, ...] = (0, 1, 2, 3, 4, 5)) -> DataFrame:
    """Histogram of left-open bins, with one for the first edge itself; empty bins are kept."""
    names = [f"eq_{edges[0]:g}"] + [f"({a:g},{b:g}]" for a, b in zip(edges, edges[1:])]
    name = F.when(value == edges[0], names[0])
    for n, a, b in zip(names[1:], edges, edges[1:]):
        name = name.when((value > a) & (value <= b), n)
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "bin_no int, bin string")
    found = df.groupBy(name.alias("bin")).agg(F.count("*").alias("n"))
    return every.join(found, "bin", "left").select("bin_no", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def imbalance(counts: DataFrame, n: str = "n") -> DataFrame:
    return counts.agg(F.round(F.max(n) / F.min(n), 6).alias("imbalance"))


def token_counts(df: DataFrame, toks: Column, top: int | None = None) -> DataFrame:
    out = df.select(F.explode(toks).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "token").limit(top) if top else out


def weighted_token_counts(df: DataFrame, c: Column, top: int | None = None) -> DataFrame:
    """Token counts by way of distinct texts: each text is tokenized once and weighs as often as it occurs."""
    texts = df.groupBy(c.alias("t")).agg(F.count("*").alias("times"))
    out = texts.select(F.explode(text.tokens(F.col("t"))).alias("token"), "times").groupBy("token").agg(F.sum("times").alias("n"))
    return out.orderBy(F.desc("n"), "token").limit(top) if top else out


def spread(df: DataFrame, group: str, token: str = "token", facet: str = "facet") -> DataFrame:
    """Per token: groups it occurs in, occurrences, and the normalized entropy (natural logarithm) over facets.

    df: a row a token occurrence with its group and facet.
    """
    docs = df.groupBy(token, group).agg(F.count("*").alias("c")).groupBy(token).agg(F.count("*").alias("doc_freq"), F.sum("c").alias("corpus_tf"))
    per = df.groupBy(token, facet).agg(F.count_distinct(group).alias("d"))
    w = Window.partitionBy(token)
    p = per.withColumn("p", F.col("d") / F.sum("d").over(w))
    ent = p.groupBy(token).agg(F.count("*").alias("facets"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    ent = ent.select(token, F.when(F.col("facets") > 1, F.col("h") / F.log("facets")).otherwise(0.0).alias("entropy_norm"))
    return docs.join(ent, token)
