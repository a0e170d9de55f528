"""Canonical tables: the best row of each key, its duplicates, rows that belong and rows that do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def best_row(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first in `order` (give a last column that breaks ties)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def duplicate_groups(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """All rows of keys that occur more than once, with the group's size and the row's rank."""
    size, rank = Window.partitionBy(key), Window.partitionBy(key).orderBy(*order)
    return df.withColumn("group_size", F.count("*").over(size)).filter("group_size >= 2").withColumn("rank_in_group", F.row_number().over(rank))


def members(df: DataFrame, key: str, member: str) -> DataFrame:
    """The distinct members of each key, joined by ` | `, and their number."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(member)), " | ").alias("all_members"), F.count_distinct(member).alias("n_members"))


def canonicalize(doctors: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per doctor the richest file (comments, reviews, rating; ties to the first file), and the comments of that file."""
    order = [F.desc_nulls_last("comments_count_in_file"), F.desc_nulls_last("reviews_count"), F.desc_nulls_last("rating_score_5"), F.asc("source_file")]
    chosen = best_row(doctors, "doctor_id", *order).withColumn("selected_source_file", F.col("source_file"))
    files = members(doctors, "doctor_id", "source_file").withColumnsRenamed({"all_members": "all_source_files", "n_members": "source_files_count"})
    chosen = chosen.join(files, "doctor_id")
    return chosen, comments.join(chosen.select("doctor_id", "source_file"), ["doctor_id", "source_file"], "left_semi")


def without_partner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of `left` that `right` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def keep_longest(df: DataFrame, key: Column, value: str, tie: str) -> DataFrame:
    """Of rows with one key, the one whose `value` is longest."""
    w = Window.partitionBy("__key").orderBy(F.desc(F.length(value)), tie)
    return df.withColumn("__key", key).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__key")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Fill `value` where it is empty from a table with one row a key; then the default."""
    named = table.select(key, F.col(value).alias("__found"))
    filled = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.nullif(F.trim("__found"), F.lit("")), F.lit(default))
    return df.join(named, key, "left").withColumn(value, filled).drop("__found")


def group_documents(df: DataFrame, group: str, order: str, value: Column, sep: str = " ") -> DataFrame:
    """The texts of each group joined in order: document, rows used, its length in characters and tokens."""
    rows = df.select(group, F.col(order).alias("o"), value.alias("t"))
    doc = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("p"))
    out = doc.select(group, F.array_join("p.t", sep).alias("document"), F.size("p").alias("comments_used"))
    return out.withColumn("doc_char_len", F.length("document")).withColumn("doc_token_len_est", F.size(F.filter(F.split("document", " "), lambda t: t != "")))


def document_digests(df: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """The figures of `group_documents` (joined by spaces) and the MD5 of each document, for groups of any size.

    A group's rows are sorted and read as a stream: neither they nor the document are ever held whole. Null texts
    add nothing but count as rows; a group without any text has no document. Null orders come last, ties by text.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        held: list = []  # the group that is open: its key, digest, rows, texts, characters, tokens

        def closed(groups: list) -> pa.RecordBatch:
            last = [[g[1].hexdigest() if g[3] else None, g[2], g[4] + g[3] - 1 if g[3] else None, g[5] if g[3] else None] for g in groups]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([g[0] for g in groups]), *[pa.array(c, t) for c, t in zip(zip(*last, strict=True), kinds, strict=True)]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts, chars, tokens = batch.columns
            same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False) | (keys[1:].is_null().to_numpy(zero_copy_only=False) & keys[:-1].is_null().to_numpy(zero_copy_only=False))
            cuts = np.r_[0, np.flatnonzero(~same) + 1, len(keys)].tolist()
            done = []
            for i, j in zip(cuts, cuts[1:]):
                key, own = keys.slice(i, 1), texts.slice(i, j - i).drop_null()
                if held and not held[0].equals(key):
                    done.append(held)
                    held = []
                held = held or [key, hashlib.md5(usedforsecurity=False), 0, 0, 0, 0]
                if len(own):
                    _, offsets, data = own.buffers()
                    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(own.type) else np.int32)
                    # each text has its space before it; the document begins without
                    held[1].update(memoryview(data)[at[own.offset] + (not held[3]) : at[own.offset + len(own)]])
                for k, more in enumerate((j - i, len(own), pc.sum(chars.slice(i, j - i)).as_py() or 0, pc.sum(tokens.slice(i, j - i)).as_py() or 0), 2):
                    held[k] += more
            if done:
                yield closed(done)
        if held:
            yield closed([held])

    names = [group, "doc_md5", "comments_used", "doc_char_len", "doc_token_len_est"]
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), value.alias("t")).repartition("g").sortWithinPartitions("g", F.asc_nulls_last("o"), "t")
    fed = rows.select("g", F.concat(F.lit(" "), "t").alias("t"), F.length("t").cast("long").alias("chars"), F.size(F.filter(F.split("t", " "), lambda t: t != "")).cast("long").alias("tokens"))
    fed = fed.withColumns({c: F.when(F.col("t").isNotNull(), F.col(c)) for c in ("chars", "tokens")})
    kinds = [StructField(group, df.schema[group].dataType), StructField(names[1], StringType()), *[StructField(c, LongType()) for c in names[2:]]]
    return fed.mapInArrow(run, StructType(kinds))
