"""Classification metrics out of the confusion matrix, and the search for weak-label thresholds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import WeakParams, weak_label

LABELS = (-1, 0, 1)


def confusion(df: DataFrame, true: str, predicted: str, labels: tuple[int, ...] = LABELS) -> DataFrame:
    """(y_true, y_pred, n) for all pairs of labels, zeros too."""
    grid = df.sparkSession.createDataFrame(list(product(labels, labels)), "y_true int, y_pred int")
    found = df.groupBy(F.col(true).cast("int").alias("y_true"), F.col(predicted).cast("int").alias("y_pred")).agg(F.count("*").alias("n"))
    return grid.join(found, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cells: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, f1 and support of each label out of (y_true, y_pred, n); zero where nothing is to divide by."""
    t = cells.groupBy(*by, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    p = cells.groupBy(*by, F.col("y_pred").alias("label")).agg(F.sum("n").alias("called"))
    both = t.join(p, [*by, "label"], "full_outer").na.fill(0, ["support", "hit", "called"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = both.withColumn("precision", ratio(F.col("hit"), F.col("called"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("called")


def report(cells: DataFrame) -> DataFrame:
    """A row a label and rows accuracy, macro and weighted: to six places."""
    c = per_class(cells).withColumn("name", F.col("label").cast("string"))
    r = lambda x: F.round(x, 6)
    rows = c.select("name", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), F.col("support").cast("long").alias("support"))
    s = F.sum("support")
    weighted = lambda x: r(F.sum(F.col(x) * F.col("support")) / s)
    macro = c.agg(F.lit("macro").alias("name"), r(F.avg("precision")).alias("precision"), r(F.avg("recall")).alias("recall"), r(F.avg("f1")).alias("f1"), s.cast("long").alias("support"))
    weigh = c.agg(F.lit("weighted").alias("name"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), s.cast("long").alias("support"))
    acc = c.agg(F.lit("accuracy").alias("name"), r(F.sum("hit") / s).alias("precision"), r(F.sum("hit") / s).alias("recall"), r(F.sum("hit") / s).alias("f1"), s.cast("long").alias("support"))
    return rows.union(acc).union(macro).union(weigh)


def errors(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.filter(F.col(true) != F.col(predicted))


def key_check(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """One row: keys wanted, got, missing and extra."""
    w, g = wanted.select(key, F.lit(1).alias("w")).distinct(), got.select(key, F.lit(1).alias("g")).distinct()
    both = w.join(g, key, "full_outer")
    return both.agg(F.count("w").alias("n_wanted"), F.count("g").alias("n_got"), F.count_if(F.col("w").isNotNull() & F.col("g").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_extra"))


#: The grid, in the order in which the first best wins.
GRID = {"neg_th": (1.6, 2.0, 2.4, 2.8), "pos_th": (1.6, 2.0, 2.4, 2.8), "info_max_words": (3, 4, 5), "mixed_margin": (0.8, 1.2, 1.6), "neg_margin_th": (0.6, 1.0, 1.4), "pos_margin_th": (0.6, 1.0, 1.4)}


def weak_grid(featured: DataFrame, true: str, row: str, grid: dict = GRID, seed: int = 42, folds: int | None = None) -> DataFrame:
    """(param_id, thresholds, macro_f1): the mean over stratified folds (min(5, max(2, n / 60)) unless given) of each set of thresholds.

    featured: rows with the columns of weak_features(). Each distinct set of features is judged
    once: rows are first counted by features, label and fold.
    """
    spark = featured.sparkSession
    base = WeakParams()
    sets = [dict(zip(grid, values)) for values in product(*grid.values())]
    # a bounded table: the product of the grid's lengths
    params = spark.createDataFrame([(i, *[float(s[k]) for k in grid]) for i, s in enumerate(sets)], "param_id int, " + ", ".join(f"g_{k} double" for k in grid))
    k = F.lit(folds) if folds else F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("__n") / 60)))
    fold = (F.row_number().over(Window.partitionBy(true).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row).cast("string"))), row)) - 1) % k
    featured = featured.crossJoin(F.broadcast(featured.agg(F.count("*").alias("__n"))))
    names = ["w_words", "w_neg", "w_pos", "w_service_strong", "w_info", "w_early", "w_self_harm", "w_improved", "w_complaint", "w_money"]
    rows = featured.withColumn("fold", fold).withColumn("w_words", F.least("w_words", F.lit(max(grid.get("info_max_words", (base.info_max_words,))) + 1)))
    counted = rows.groupBy("fold", F.col(true).alias("y_true"), *names).agg(F.count("*").alias("n"))
    v = {name: F.col(f"g_{name}") if name in grid else F.lit(value) for name, value in vars(base).items()}
    judged = counted.crossJoin(F.broadcast(params)).withColumn("y_pred", weak_label(v)["label"])
    cells = judged.groupBy("param_id", "fold", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    f1 = per_class(cells, "param_id", "fold").groupBy("param_id", "fold").agg((F.sum("f1") / len(LABELS)).alias("f1"))
    mean = f1.groupBy("param_id").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return params.join(mean, "param_id").select("param_id", *[F.col(f"g_{x}").alias(x) for x in grid], "macro_f1")


def best_params(scored: DataFrame) -> DataFrame:
    """The first set of thresholds with the largest mean."""
    return scored.orderBy(F.desc("macro_f1"), "param_id").limit(1)
