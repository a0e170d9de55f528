"""Text classifiers: hashed TF-IDF features and Spark ML estimators."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: The classifiers' token pattern: words of two characters or more.
WORDS = text.U + r"\b\w\w+\b"


def features(df: DataFrame, c: Column) -> DataFrame:
    """Adds `terms`: lower-case words and their bigrams."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORDS), F.lit(0))
    return df.withColumn("terms", text.ngrams(toks))


def fit(train: DataFrame, label: str = "class_id", kind: str = "mlp", buckets: int = 1 << 12, classes: int = 3, weight: str | None = None, seed: int = 42, max_iter: int = 60):
    """A pipeline on the `terms` column. kind: mlp (256 and 64 hidden units, sigmoid) or logistic (takes a weight column).

    Functionally similar to the published networks, not numerically equal to them: other optimizer and activation.
    """
    stages = [HashingTF(inputCol="terms", outputCol="tf", numFeatures=buckets), IDF(inputCol="tf", outputCol="features", minDocFreq=1)]
    if kind == "mlp":
        stages.append(MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=[buckets, 256, 64, classes], seed=seed, maxIter=max_iter))
    else:
        stages.append(LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter, regParam=0.01, **({"weightCol": weight} if weight else {})))
    return Pipeline(stages=stages).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    """Adds predicted (-1, 0, 1) and the probability of each class."""
    out = model.transform(df).withColumn("__p", vector_to_array("probability"))
    return out.withColumn("predicted", F.col("prediction").cast("int") - 1).withColumn("probabilities", F.transform("__p", lambda x: F.round(x, 6))).drop("__p", "tf", "features", "rawPrediction", "probability", "prediction")


def transformer(name: str = "transformers"):
    """The optional library for fine-tuned transformers; it is not part of this engine."""
    try:
        return __import__(name)
    except ImportError as e:
        raise NotImplementedError(f"{name} is not installed: transformer models need it and its weights") from e
