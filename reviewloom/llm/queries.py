"""The queries of this subpackage: an operator each, over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from .common import table
from .quality_sql import OP9_SQL


def op1_harmonic_packing(spark, sf_dir):
    from .packing import HarmonicPacker

    return HarmonicPacker().pack(table(spark, sf_dir, "documents"))


def op2_token_shards(spark, sf_dir):
    from .shards import write_and_read

    return write_and_read(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_subword_toxicity(spark, sf_dir):
    from .toxicity import ToxicityModel

    return ToxicityModel().score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chunked_bpe(spark, sf_dir):
    from .chunked_bpe import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_multiprobe_neighbours(spark, sf_dir):
    from .multiprobe import MultiProbe

    return MultiProbe().search(table(spark, sf_dir, "embeddings"))


def op6_simhash_components(spark, sf_dir):
    from pyspark.sql import functions as F

    from .simhash import classes

    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_feistel_pseudonyms(spark, sf_dir):
    from .pii import pseudonymize, run_key

    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), run_key(spark), count="n_pii")


def op8_line_alignment(spark, sf_dir):
    from .linededup import dedup

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed_lines")


def op9_quality_divergence(spark, sf_dir):
    from .quality import QualityRules

    return QualityRules().score(table(spark, sf_dir, "documents"))


def op10_ppm_code_length(spark, sf_dir):
    from .ppm import score

    return score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_harmonic_packing, op2_token_shards, op3_subword_toxicity, op4_chunked_bpe, op5_multiprobe_neighbours, op6_simhash_components, op7_feistel_pseudonyms, op8_line_alignment, op9_quality_divergence, op10_ppm_code_length)}
ORACLE_SQL: dict[str, str] = {"op9_quality_divergence": OP9_SQL}
