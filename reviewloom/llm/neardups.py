"""Near-duplicates by the Jaccard similarity of the sets of five-word shingles: 4/5 or more.

Candidates, first: sets whose SimHash fingerprints differ in at most two bits meet by the
multi-index hashing of simhash. Pairs at 4/5 are mostly further apart, and a radius that reaches
them has no selective halves, so a second step finds those beyond two bits: a set's MinHash signature
has BANDS bands of ROWS minima; sets that agree in a band meet. A pair at a similarity of s is missed
there with probability (1 - s ** ROWS) ** BANDS: 5e-6 at 0.8, 7e-14 at 0.9. Candidates of both steps
are verified by their whole sets, in whole numbers; no link rests on a fingerprint or a signature.

Equal sets are one entry from the start. Then each set is compared with the earliest one of
each of its buckets. Only the sets of buckets that still hold several components go on: those
outside the earliest one's component are compared with all sets of other components that share
one of their rarest shingles, as any set at 4/5 or more must (prefix and positional filters, as
in Xiao et al., 2008). So a large group of copies costs a number of pairs in proportion to its
size, copies that differ too much meet seldom, and no pair of a bucket that could join two
components is left out.

Defined results: as those of simhash, whose hashes and components are used: texts of fewer
than five words have one shingle, null and empty texts are near-duplicates of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import column, materialize
from .encoder import slices
from .simhash import components, fingerprint, hashes

BANDS, ROWS = 40, 6
WIDTH = 5
_RNG = np.random.default_rng(17)
_A = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)
T = "__rl_n_"


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(hashes(text, width))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key a band, as signed numbers; equal minima of a band give equal keys."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(own), 1024):
        x = _A[:, None] * own[None, i : i + 1024] + _B[:, None]
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=1), out=least)
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def _node(own: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0
    return h - (1 << 64) if h >> 63 else h


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those with a Jaccard similarity of 4/5 or more."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    # common / (x + y - common) >= 4 / 5
    return met.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def prefixes(held: DataFrame) -> DataFrame:
    """(node, n, root, outside, s, i): of each set, the shingles s that another set may share first, and their places i.

    Shingles are ordered by the number of sets that hold them, rarest first. A partner at 4/5 or more
    shares 4/5 of a set of n, so one of its first n - ceil(4n/5) + 1; shingles of one set alone are left out.
    """
    each = held.select("node", "n", "root", "outside", F.explode("own").alias("s"))
    counted = each.join(each.groupBy("s").agg(F.count("*").alias("c")), "s")
    ranked = counted.groupBy("node", "n", "root", "outside").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("all"))
    first = F.expr("slice(`all`, 1, n - (4 * n + 4) div 5 + 1)")
    return ranked.select("node", "n", "root", "outside", F.posexplode(first).alias("i", "e")).filter("e.c > 1").select("node", "n", "root", "outside", F.col("e.s").alias("s"), "i")


def sized(p, q):
    """Whether sets of p and q shingles can be at 4/5 or more."""
    return 5 * F.least(p, q) >= 4 * F.greatest(p, q)


def close_prints(distinct: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are equal, or linked by the multi-index hashing of simhash (two bits or fewer).

    The earliest set of each fingerprint stands for it.
    """
    heads = materialize(distinct.groupBy("fp").agg(F.min(F.struct("first", "node", "n")).alias("o")).select("fp", F.col("o.node").alias("head"), F.col("o.n").alias("head_n")), "heads")
    same = distinct.select("fp", "node", "n").join(heads, "fp").filter(F.col("node") != F.col("head")).select("node", "n", "head", "head_n")
    p, q = (heads.select(F.col("fp").alias(x), F.col("head").alias(to), F.col("head_n").alias(n)) for x, to, n in (("a", "node", "n"), ("b", "head", "head_n")))
    near = simhash.links(heads.select("fp")).join(p, "a").join(q, "b").select("node", "n", "head", "head_n")
    met = same.unionByName(near).filter(sized(F.col("n"), F.col("head_n")))
    return met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))


def links(distinct: DataFrame, own: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b): verified links that connect all near-duplicates among the distinct sets.

    distinct: node, first (struct<d, t>, a row that has the set), n (its size), fp (that row's fingerprint), keys. own: d, t, text.
    """
    entries = distinct.select("node", "first", "n", F.explode("keys").alias("key"))
    least = entries.groupBy("key").agg(F.min(F.struct("first", "node", "n")).alias("o"), F.count("*").alias("held")).filter("held > 1")
    met = entries.select("node", "n", "key").join(least.select("key", F.col("o.node").alias("head"), F.col("o.n").alias("head_n")), "key")
    met = materialize(met, "buckets")
    star = met.filter((F.col("node") != F.col("head")) & sized(F.col("n"), F.col("head_n")))
    star = star.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    star = materialize(close_prints(distinct).unionByName(star).distinct(), "pairs")

    def run(batches):
        for batch in batches:
            nodes, texts = column(batch, "node"), column(batch, "text")
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i:j], pa.int64()), pa.array([shingle_set(x, width).view(np.int64) for x in texts[i:j]], pa.list_(pa.int64()))], names=["node", "own"])

    nodes = met.select("node").unionByName(star.select(F.col("a").alias("node"))).unionByName(star.select(F.col("b").alias("node")))
    wanted = distinct.select("node", "first.d", "first.t").join(nodes.distinct(), "node")
    texts = own.join(wanted, ["d", "t"]).dropDuplicates(["node"]).select("node", "text")
    sets = materialize(texts.mapInArrow(run, "node long, own array<long>"), "sets")
    near = materialize(verified(star, sets), "near")

    roots = components(near).withColumnRenamed("node", "of")
    rooted = met.select("node", "n", "key", "head").join(roots.select(F.col("of").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(roots.select(F.col("of").alias("head"), F.col("root").alias("head_root")), "head", "left").withColumn("head_root", F.coalesce("head_root", "head"))
    rooted = materialize(rooted, "rooted")
    # sets of the buckets that still hold several components; those outside the earliest one's look for partners among all
    several = rooted.join(rooted.filter("root != head_root").select("key").distinct(), "key", "left_semi")
    left = several.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.bool_or(F.col("root") != F.col("head_root")).alias("outside"))
    marked = materialize(prefixes(sets.join(left, "node")), "prefixes")
    p, q = (marked.select("s", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "root", "i", "outside")]) for x in "pq")
    # at the first common shingle, what follows it in either set bounds the common ones
    most = 1 + F.least(F.col("p_n") - 1 - F.col("p_i"), F.col("q_n") - 1 - F.col("q_i"))
    rest = p.filter("p_outside").join(q, "s").filter((F.col("p_root") != F.col("q_root")) & sized(F.col("p_n"), F.col("q_n")) & (9 * most >= 4 * (F.col("p_n") + F.col("q_n"))))
    rest = rest.select(F.col("p_node").alias("p"), F.col("q_node").alias("q"))
    rest = rest.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    return near.unionByName(verified(rest, sets))


def survivors(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest doc_id, with all columns.

    Of rows with one doc_id, a hash of the text decides; of equal rows, one stays; a null doc_id is greater than all.
    """
    d, t = T + "d", T + "t"
    keyed = documents.withColumn(d, F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).withColumn(t, F.xxhash64("text"))

    def run(batches):
        for batch in batches:
            ds, ts, texts = batch.column("d"), batch.column("t"), column(batch, "text")
            for i, j in slices(texts):
                each = [hashes(x, width) for x in texts[i:j]]
                sets = list(map(np.unique, each))
                made = [pa.array(list(map(_node, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(fingerprint, each)), pa.int64()), pa.array(list(map(band_keys, sets)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([ds.slice(i, j - i), ts.slice(i, j - i), *made], names=["d", "t", "node", "n", "fp", "keys"])

    own = keyed.select(F.col(d).alias("d"), F.col(t).alias("t"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    prints = materialize(own.mapInArrow(run, "d long, t long, node long, n int, fp long, keys array<long>"), "signatures")
    first = F.struct("d", "t").alias("first")
    distinct = prints.groupBy("node").agg(F.min(F.struct(first, "n", "fp", "keys")).alias("o")).select("node", "o.first", "o.n", "o.fp", "o.keys")
    distinct = materialize(distinct, "distinct")
    roots = components(links(distinct, own, width)).withColumnRenamed("node", "of")
    held = distinct.select("node", "first").join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    chosen = held.select(F.col("first.d").alias(d), F.col("first.t").alias(t))
    return keyed.join(chosen, [d, t], "left_semi").dropDuplicates([d, t]).select(*[F.col(f"`{c}`") for c in documents.columns])
