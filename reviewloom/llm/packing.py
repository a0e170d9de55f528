"""Harmonic packing: pieces of token sequences dealt into classes of reciprocal size.

A piece of n tokens belongs to class k = capacity // n: bins of class k hold exactly k
pieces, whatever they are, so a piece's bin is its rank in its class divided by k. Ranks
need no common state: each worker numbers its own pieces of each class, and one prefix
sum over (class, worker) counts moves those numbers apart. Documents may be cut: whole
blocks of the capacity come first; of what is left, a piece that would leave much of its
class's share empty gives up a piece of exactly the next share, capacity // (k + 1).
What remains at the end of each class, fewer than k pieces, is bounded by a constant
(about 10,000 pieces for 2048 tokens, whatever the input) and is packed by first fit.

Defined results: null and empty texts are one piece with the end token alone; repeated
doc_id values and rows are packed as rows of their own; a null doc_id is kept; other
columns of the input are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, doc_texts, materialize
from .encoder import default_tokenizer, encoder, slices

_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, worker long, slot long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(n: int, capacity: int, max_waste: float) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` tokens, in order."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < n:
        left = n - at
        k = capacity // left
        if capacity - k * left > max_waste * capacity:
            left = capacity // (k + 1)
        out.append((at, left))
        at += left
    return out


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, given in the order in which they are placed."""
    used: list[int] = []
    out = []
    for n in lengths:
        for b, u in enumerate(used):
            if u + n <= capacity:
                break
        else:
            b, u = len(used), 0
            used.append(0)
        out.append((b, u))
        used[b] = u + n
    return out


@dataclass(frozen=True)
class HarmonicPacker:
    """capacity: tokens of a sequence. max_waste: share of the capacity that a class may leave empty before a piece is cut."""

    capacity: int = 2048
    max_waste: float = 1 / 64
    end_id: int = 1
    tokenizer: str | None = None

    def pieces(self, documents: DataFrame) -> DataFrame:
        """Encode and cut: one row a piece, with its class and its number there on the worker that made it."""
        path, capacity, waste, end = self.tokenizer or default_tokenizer(), self.capacity, self.max_waste, self.end_id

        def run(batches):
            worker, filled = TaskContext.get().partitionId(), {}
            tail = end.to_bytes(4, "little")
            for batch in batches:
                keys, texts = column(batch, "doc_id"), column(batch, "text")
                rows = []
                for i, j in slices(texts):
                    for key, ids in zip(keys[i:j], encoder(path).encode(texts[i:j]), strict=True):
                        ids += tail
                        n = len(ids) // 4
                        for start, length in cut(n, capacity, waste):
                            k = capacity // length
                            slot = filled.get(k, 0)
                            filled[k] = slot + 1
                            rows.append((key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k, worker, slot))
                if rows:
                    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "slot")
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        return doc_texts(documents).mapInArrow(run, _CUT)

    def place(self, pieces: DataFrame) -> DataFrame:
        """Sequences and offsets for cut pieces (a stored table: it is read twice)."""
        capacity = self.capacity
        by_worker = pieces.groupBy("class", "worker").agg((F.max("slot") + 1).alias("n"))
        base = by_worker.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # one row a class: fewer than 2 * sqrt(capacity) rows
        totals = by_worker.groupBy("class").agg(F.sum("n").alias("n")).withColumn("full", F.expr("n div class"))
        totals = totals.withColumn("first", F.coalesce(F.sum("full").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all_full", F.sum("full").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("n")
        base = base.join(totals, "class").drop("n")
        ranked = pieces.join(base, ["class", "worker"]).withColumn("rank", F.col("base") + F.col("slot")).withColumn("bin", F.expr("rank div class"))
        inside = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        full = ranked.filter("bin < full").withColumn("sequence_id", F.col("first") + F.col("bin")).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

        def fit(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["rank"], r["class"]))
            placed = first_fit([r["length"] for r in rows], capacity)
            out = [{**r, "sequence_id": r["all_full"] + b, "offset": o} for r, (b, o) in zip(rows, placed, strict=True)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.table({c: pa.array([r[c] for r in out], pa.int64()) for c in names})

        left = ranked.filter("bin >= full").groupBy("all_full").applyInArrow(fit, PIECES)
        names = left.columns
        return full.select(names).unionByName(left)

    def pack(self, documents: DataFrame) -> DataFrame:
        """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
        return self.place(materialize(self.pieces(documents), "pieces"))

    def sequences(self, documents: DataFrame, pieces: DataFrame) -> DataFrame:
        """The packed sequences themselves: sequence_id, ids (without padding), doc_ids and offsets of their pieces.

        The documents are encoded again; rows with one doc_id and different texts are told apart by the pieces' checksums.
        """
        path, end = self.tokenizer or default_tokenizer(), self.end_id
        asked = pieces.groupBy("doc_id").agg(F.collect_set(F.struct("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")).alias("asked"))
        joined = doc_texts(documents).distinct().alias("d").join(asked.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id"))).select("d.doc_id", "text", "asked")

        def run(batches):
            import numpy as np

            tail = end.to_bytes(4, "little")
            for batch in batches:
                texts, rows = column(batch, "text"), []
                for (key, text, asked), ids in zip(zip(column(batch, "doc_id"), texts, column(batch, "asked"), strict=True), encoder(path).encode(texts), strict=True):
                    ids += tail
                    for p in asked:
                        piece = ids[4 * p["start"] : 4 * (p["start"] + p["length"])]
                        if len(ids) == 4 * p["doc_tokens"] and zlib.crc32(piece) == p["ids_crc32"]:
                            rows.append((p["sequence_id"], p["offset"], key, np.frombuffer(piece, "<u4").tolist()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sequence_id", "offset", "doc_id", "ids"])

        flat = joined.mapInArrow(run, "sequence_id long, offset long, doc_id long, ids array<int>")
        own = flat.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
        return own.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
