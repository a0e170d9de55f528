"""SimHash fingerprints and their links by multi-index hashing.

Fingerprint: 64 bits; a bit is 1 if set in more than half of the hashes (XXH64, seed 42)
of the text's 3-word shingles, repeats included.

Links (two fingerprints that differ in at most `radius` bits): the bits are split into
two halves. Of two such fingerprints, one half differs in at most radius // 2 bits, so
each fingerprint is entered in a table under either half, and looks up the small Hamming
ball around its own half; what it meets is verified by the whole distance. Equal
fingerprints are one entry from the start.

Of the ball, just the values with one more bit set are looked up: the pair's other
member has that bit, so either order of a pair is met once.

A bucket holds the fingerprints of one value of one half. A bucket of more than
`split_over` entries is not compared pair by pair. Its entries file themselves under
every point within one bit of their other half, and a visitor under its own other half:
whatever shares a point is within two bits, and whatever is within two bits shares one.
So each of a point's fingerprints (65 at most) is linked to the least of them: the same
components from a number of rows in proportion to the bucket.

Components are found by alternating star contraction, each round a written table.

Defined results: null and empty texts have fingerprint zero and are linked like any
other; repeated rows are kept, each with its component; a null doc_id takes part but is
no component's name unless all ids there are null; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_texts, materialize
from .encoder import slices

RADIUS = 2
SPLIT_OVER = 64


def hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `width` words; fewer words: of all of them; none: no hashes."""
    ws = text.encode().lower().split()  # bytes: just A-Z, and ASCII white space
    if not ws:
        return np.empty(0, np.uint64)
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    h = xxhash.xxh64_intdigest
    if len(ws) <= width:
        return np.array([h(line, 42)], np.uint64)
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(ws) - width + 1)


def fingerprint(h: np.ndarray) -> int:
    """Majority bits of the hashes, as a signed 64-bit number; none: 0."""
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        own = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            keys, texts = column(batch, "doc_id"), column(batch, "text")
            for i, j in slices(texts):
                fp = [fingerprint(hashes(t, width)) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return doc_texts(documents).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that differ in at most two bits; all of them but in large
    buckets, where they connect the same fingerprints."""
    half = lambda fp, seg: F.when(seg == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    fp, seg, val, other = F.col("fp"), F.col("seg"), F.col("val"), F.col("other")
    entries = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg"))
    entries = entries.select("fp", "seg", half(fp, seg).alias("val"))
    # the value itself, and those with one more bit
    ball = F.expr("concat(array(val), transform(filter(sequence(0, 31), b -> (shiftright(val, b) & 1L) = 0L), b -> val | shiftleft(1L, b)))")
    probes = entries.select("fp", "seg", F.explode(ball).alias("val"), F.col("val").alias("own"))
    counted = entries.groupBy("seg", "val").agg(F.count("*").alias("n"))
    large = counted.filter(F.col("n") > split_over).select("seg", "val")
    small = entries.join(large, ["seg", "val"], "left_anti").select("seg", "val", F.col("fp").alias("met"))
    near = probes.join(small, ["seg", "val"]).filter((fp != F.col("met")) & (F.expr("bit_count(fp ^ met)") <= RADIUS)).select(F.least("fp", "met").alias("a"), F.greatest("fp", "met").alias("b"))
    visits = probes.join(large, ["seg", "val"], "left_semi").withColumn("other", half(fp, 1 - seg))
    points = F.when(val == F.col("own"), F.expr("concat(array(other), transform(sequence(0, 31), b -> other ^ shiftleft(1L, b)))")).otherwise(F.array(other))
    filed = visits.select("fp", "seg", "val", F.explode(points).alias("point"))
    least = filed.groupBy("seg", "val", "point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    star = least.select("a", F.explode("all").alias("b")).filter("a != b")
    return near.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Each is a
    minimum per node, joined to the node's edges: no node's edges are gathered in a row.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while True:
        # every node's neighbours hang themselves under the least of them and the node
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # a node and its smaller neighbours hang themselves under the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        edges = materialize(small, "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(documents: DataFrame, width: int = 3, split_over: int = SPLIT_OVER) -> DataFrame:
    """doc_id, fp, component_id: the component's smallest doc_id, for every document."""
    prints = materialize(fingerprints(documents, width), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(distinct.select("fp"), split_over)).withColumnRenamed("node", "fp")
    held = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = held.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = held.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
