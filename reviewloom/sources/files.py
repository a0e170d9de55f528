"""Files in and out: raw JSON profiles, CSV tables, JSON lines, word lists, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = """doctor_profile STRUCT<doctor_id: STRING, profile_url: STRING, nice_id: STRING, name: STRING, specialty: STRING, medical_code: STRING,
  verified: BOOLEAN, followers_count: INT, reviews_count: INT, rating_percent: DOUBLE, rating_score_5: DOUBLE, biography: STRING,
  social_media: MAP<STRING, STRING>, phones: ARRAY<STRING>,
  offices: ARRAY<STRUCT<office_id: STRING, title: STRING, address: STRING, description: STRING, phones: ARRAY<STRING>, holiday_note: STRING>>, schedule: ARRAY<STRING>>,
  comments ARRAY<STRUCT<text: STRING, rate: DOUBLE, label: INT, date: STRING, `like`: INT, dislike: INT>>, _corrupt STRING"""


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its name, profile and comments; files that are no JSON have `failed` true."""
    raw = spark.read.schema(RAW).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.select(F.col("_metadata.file_name").alias("source_file"), "doctor_profile", "comments", F.col("_corrupt").isNotNull().alias("failed"))


def flatten_profiles(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doctors, comments): the profile's columns, and the comments with their place in the file."""
    ok = raw.filter(~F.col("failed"))
    p = F.col("doctor_profile")
    doctors = ok.select(
        p["doctor_id"].alias("doctor_id"), "source_file", *[p[c].alias(c) for c in ("profile_url", "nice_id", "name", "specialty", "medical_code")],
        F.coalesce(p["verified"], F.lit(False)).alias("verified"), *[p[c].alias(c) for c in ("followers_count", "reviews_count", "rating_percent", "rating_score_5", "biography")],
        F.coalesce(F.size(p["offices"]), F.lit(0)).alias("office_count"), F.coalesce(F.size("comments"), F.lit(0)).alias("comments_count_in_file"),
    )
    comments = ok.select(p["doctor_id"].alias("doctor_id"), "source_file", p["specialty"].alias("specialty"), F.posexplode("comments").alias("comment_index_in_file", "c"))
    return doctors, comments.select("doctor_id", "source_file", "comment_index_in_file", "specialty", "c.text", "c.rate", "c.label", "c.date")


def read_csv(spark: SparkSession, path: str, schema: str, keep_empty: bool = True) -> DataFrame:
    """A CSV table with a header (a byte-order mark before it is dropped); keep_empty: empty fields are '', not null."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    df = reader.option("emptyValue", "").csv(path)
    return df.na.fill("") if keep_empty else df  # fills strings alone


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.limit(limit) if limit else df


def pool_json(df: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """A JSON line a pool row, the numbers in a nested `meta`."""
    meta = F.struct("doctor_id", "specialty", "rate", F.col("label").alias("label_from_rate"), "bucket", "neg_score", "pos_score", "neg_hits", "pos_hits")
    return df.select(F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), "item_id", F.col("text_label").alias("text"), meta.alias("meta"))).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def read_stopwords(spark: SparkSession, path: str, single_words: bool = True) -> DataFrame:
    """One token a line; blank lines and # lines are skipped, with `single_words` also lines with a space."""
    from ..functions.text import norm_token

    t = F.trim("value")
    lines = spark.read.text(path).filter((t != "") & ~t.startswith("#"))
    if single_words:
        lines = lines.filter(~t.contains(" "))
    return lines.select(norm_token(F.col("value")).alias("token")).distinct()


LOG = "item_id STRING, label_llm INT, llm_confidence DOUBLE, confidence_int INT, model STRING, status STRING, batch_id STRING, ts_utc STRING"


def is_done() -> Column:
    """A log record that is valid and complete."""
    return (F.col("status") == "ok") & F.col("item_id").isNotNull() & F.col("label_llm").isin(-1, 0, 1)


def still_to_do(items: DataFrame, log: DataFrame) -> DataFrame:
    return items.join(log.filter(is_done()).select("item_id").distinct(), "item_id", "left_anti")


def latest(log: DataFrame) -> DataFrame:
    """The last valid record of each item."""
    order = F.struct("ts_utc", F.coalesce("batch_id", F.lit("")), "label_llm")
    cols = [c for c in log.columns if c != "item_id"]
    return log.filter(is_done()).groupBy("item_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("item_id", "r.*")


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def report(df: DataFrame, section: str) -> DataFrame:
    """A one-row table of measures as rows (section, metric, value)."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in df.columns]
    return df.select(F.lit(section).alias("section"), F.explode(F.array(*pairs)).alias("m")).select("section", "m.metric", "m.value")
