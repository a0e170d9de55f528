"""Repair of model answers that should be JSON arrays of {item_id, label, ...}."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

ITEM = "array<struct<item_id: string, label: string, confidence: string>>"


def sanitize(c: Column) -> Column:
    """No code fences, `0.` to `0.0`, no commas before a closing bracket."""
    c = F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*|\s*```$", "")
    c = F.regexp_replace(c, r"(\d)\.(?=\s*[,}\]])", "$1.0")
    return F.regexp_replace(c, r",(?=\s*[}\]])", "")


def parse_array(c: Column, schema: str = ITEM) -> Column:
    """The array, or that between the outermost brackets, or null."""
    direct = F.from_json(c, schema)
    inner = F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit("")), schema)
    return F.coalesce(F.when(F.trim(c).startswith("["), direct), inner)


def salvage_flat(c: Column) -> Column:
    """Complete objects without inner braces, as strings."""
    return F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), F.lit(0))


def complete_objects(s: str | None) -> list[str]:
    """Complete top-level objects of a text, by decoding from each opening brace that is not inside one."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while s and (at := s.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(s, at)
            out.append(s[at:end])
            at = end
        except ValueError:
            at += 1
    return out


@F.pandas_udf(ArrayType(StringType()))
def salvage_nested(s: pd.Series) -> pd.Series:
    """As salvage_flat, for objects with braces inside objects or strings."""
    return s.map(complete_objects)


def map_results(answers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, missing): the first valid answer for each wanted item_id, and wanted ids without one.

    answers: batch_id, pos, item_id, label, confidence (strings, in the answer's order).
    """
    label = F.col("label").try_cast("double")
    conf = F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(50.0)), F.lit(0.0)), F.lit(100.0)).cast("int")
    valid = answers.filter(label.isin(-1.0, 0.0, 1.0)).join(wanted.select("item_id").distinct(), "item_id", "left_semi")
    first = Window.partitionBy("item_id").orderBy("batch_id", "pos")
    got = valid.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("item_id", label.cast("int").alias("label_llm"), conf.alias("confidence_int"), (conf / 100).alias("llm_confidence"))
    return got, wanted.join(got.select("item_id"), "item_id", "left_anti")
