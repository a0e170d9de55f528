"""Nearest neighbours by multiprobe p-stable hashing.

Index: each of `tables` tables hashes a vector to a bucket by Gaussian projections cut
into intervals (p-stable hashing for the Euclidean distance). Every vector is entered in
every table, as a row by (table, bucket); a task packs what it has of a bucket, `pack`
vectors a row at most, and equal vectors there into one with its smallest ids, so a hot
bucket is many rows that a join can split, and a group of copies a few entries.

Probes: a query looks into its own bucket and into perturbed ones. How likely a bucket
holds near vectors is estimated by its score: the sum, over the projections, of the squared
distance from the query's projection to the bucket's interval. A query's sequence of buckets is
enumerated from the least score upward, without looking at the table, down to a depth
that is fitted once. Probes and entries are joined by (table, bucket); what the tables offer
is merged, and exact distances on the original vectors decide.

Fit, for each length of vectors with at least `few` rows: `sample_queries` vectors of a sample (`sample` rows by a
hash of vec_id) are compared with all rows, in one pass; the depth is the score at which
the tables together find `target_recall` of their true neighbours. The number of
projections is the one that costs least by an estimate from the sample: probes, and rows
in the buckets that are probed. Clustered vectors get many projections and few probes;
near uniform ones few projections, as no hash separates their neighbours.

Last step, exact: a query that holds fewer than k rows, or whose k-th is farther than any
that the depth was fitted to (by `reach` times), is an outlier for which buckets say little. It goes on through all
buckets, that is, is compared with all rows of its length, in blocks of such queries.
Lengths with fewer than `few` rows are one bucket.

Defined results: null and zero vectors, and such with null or non-finite components,
take no part; vectors are compared with vectors of their length only; rows equal in
vec_id and vector count once, and each vector of a vec_id takes part (a query never meets
rows of its own vec_id; several vectors of one query id are searched each); null ids take
no part; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize

FEW = 256
_NEAR = "query_id long, qh long, vec_id long, score double, x binary"


@dataclass(frozen=True)
class Fit:
    """For vectors of one length: projections of a table, the width of an interval, the largest score that is probed, the distance that this is good for."""

    hashes: int
    width: float
    depth: float
    reach: float


def nearest(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance): for each row of q at least its k nearest of x, and all that tie with the last of them."""
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    near = xx[None] + qq[:, None] - 2 * (q @ x.T)
    if len(x) > k:
        slack = 1e-9 * (xx.max() + qq)[:, None]  # of what rounding may do to the estimate
        qi, xi = np.nonzero(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack)
    else:
        qi, xi = (a.ravel() for a in np.indices(near.shape))
    out = np.empty(len(qi))
    for i in range(0, len(qi), 1 << 16):
        out[i : i + (1 << 16)] = np.sqrt(((x[xi[i : i + (1 << 16)]] - q[qi[i : i + (1 << 16)]]) ** 2).sum(axis=1))
    return qi, xi, out


def best(k: int, query: np.ndarray, qh: np.ndarray, vec: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the k best rows of each query, nearest first, ties to smaller ids, each (id, distance) once."""
    if not len(query):
        return np.zeros(0, np.int64)
    order = np.lexsort((vec, score, qh, query))
    a, b, c, d = query[order], qh[order], vec[order], score[order]
    same = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    kept = ~(same & np.r_[False, (c[1:] == c[:-1]) & (d[1:] == d[:-1])])
    order, first = order[kept], ~same[kept]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k]


class Found:
    """The best rows of many queries so far, in bounded memory: at most about `limit` rows and k a query."""

    def __init__(self, k: int, with_x: bool = False, limit: int = 1_000_000):
        self.k, self.with_x, self.limit, self.held, self.parts = k, with_x, limit, 0, []

    def add(self, x: np.ndarray, ids: np.ndarray, counts: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_hashes: np.ndarray) -> None:
        """ids: of each row of x, counts[row] of them, one row after another."""
        qi, xi, score = nearest(x, q, self.k + 1)
        times, starts = counts[xi], np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(xi)), times)
        vec = ids[np.repeat(starts[xi], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
        own = q_ids[qi][row] != vec
        row, vec = row[own], vec[own]
        part = [q_ids[qi][row], q_hashes[qi][row], vec, score[row]]
        at = best(self.k, *part)
        self.parts.append([c[at] for c in part] + [x[xi[row[at]]] if self.with_x else np.zeros((len(at), 0))])
        self.held += len(at)
        if self.held > self.limit:
            self.reduce()
            self.limit = max(self.limit, 2 * self.held)

    def reduce(self) -> list[np.ndarray]:
        if not self.parts:
            return []
        whole = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if len({p[4].shape[1] for p in self.parts}) == 1 else None
        if whole is None:  # vectors of several lengths: each on its own
            return [p for n in sorted({p[4].shape[1] for p in self.parts}) for p in self._of(n)]
        at = best(self.k, *whole[:4])
        self.parts = [[c[at] for c in whole]]
        self.held = len(at)
        return self.parts

    def _of(self, n: int) -> list:
        own = Found(self.k, self.with_x)
        own.parts = [p for p in self.parts if p[4].shape[1] == n]
        return own.reduce()

    def batches(self) -> Iterator[pa.RecordBatch]:
        for query, qh, vec, score, x in self.reduce():
            for i in range(0, len(query), 10_000):
                j = slice(i, i + 10_000)
                kept = pa.array([v.tobytes() for v in x[j]], pa.binary()) if x.shape[1] else pa.nulls(len(query[j]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(query[j]), pa.array(qh[j]), pa.array(vec[j]), pa.array(score[j]), kept], names=["query_id", "qh", "vec_id", "score", "x"])


def blocks(batches: Iterator, most_bytes: int = 32 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors in their own type) of about `most_bytes` each."""
    held: dict[int, list] = {}
    size = 0

    def out():
        for dim, parts in sorted(held.items()):
            yield dim, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        held.clear()

    for batch in batches:
        ids, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
        dims = np.diff(vectors.offsets.to_numpy())
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            held.setdefault(dim, []).append((ids[at], x))
            size += x.nbytes
        if size >= most_bytes:
            yield from out()
            size = 0
    yield from out()


def hashes_of(x: np.ndarray) -> np.ndarray:
    """A 64-bit number a vector."""
    return np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in x], np.uint64).view(np.int64)


@dataclass(frozen=True)
class MultiProbe:
    k: int = 10
    tables: int = 4
    #: numbers of projections of a table to choose from
    choices: tuple[int, ...] = (2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 20, 24)
    #: of an interval, in standard deviations of a projection
    width: float = 2.0
    sample: int = 4096
    sample_queries: int = 128
    target_recall: float = 0.95
    few: int = FEW
    #: vectors of a packed row
    pack: int = 512
    #: a probe costs about as much as so many distances
    probe_cost: float = 100.0
    reach: float = 1.25
    seed: int = 11

    def projections(self, dim: int, hashes: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table: directions, and shifts in intervals."""
        rng = np.random.default_rng((self.seed, dim, hashes))
        return [(rng.normal(size=(dim, hashes)), rng.uniform(0, 1, hashes)) for _ in range(self.tables)]

    def keys(self, dim: int, table: int, codes: np.ndarray) -> np.ndarray:
        """One number for each (table, bucket); buckets that share one by chance only add candidates."""
        rng = np.random.default_rng((self.seed, dim, table, codes.shape[1]))
        factors = rng.integers(0, 1 << 63, codes.shape[1], np.uint64) << np.uint64(1) | np.uint64(1)
        h = (codes.astype(np.int64).view(np.uint64) * factors).sum(axis=1, dtype=np.uint64) + rng.integers(0, 1 << 63, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    @staticmethod
    def gaps(at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of a projection, in intervals, to each interval, by projection."""
        return np.maximum(np.maximum(codes - at, at - codes - 1), 0)

    def entries(self, dim: int, x: np.ndarray, fit: Fit | None) -> Iterator[np.ndarray]:
        """For each table, the key of each vector's bucket."""
        if fit is None:
            yield self.keys(dim, 0, np.zeros((len(x), 1)))
            return
        for t, (a, b) in enumerate(self.projections(dim, fit.hashes)):
            yield self.keys(dim, t, np.floor(x @ a / fit.width + b))

    def sequence(self, at: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, bucket, score) of all buckets within `depth` of each query's projections, by query in ascending order of score."""
        own, codes, score = np.arange(len(at)), np.zeros((len(at), 0)), np.zeros(len(at))
        for i in range(at.shape[1]):
            base = np.floor(at[:, i])
            grown = []
            reach = int(np.ceil(np.sqrt(depth)))
            for step in range(-reach - 1, reach + 2):
                code = base + step
                s = score + (self.gaps(at[:, i], code) ** 2)[own]
                ok = np.flatnonzero(s <= depth)
                if len(ok):
                    grown.append((own[ok], np.column_stack([codes[ok], code[own[ok]]]), s[ok]))
            own, codes, score = (np.concatenate(c) for c in zip(*grown, strict=True))
        order = np.lexsort((score, own))
        return own[order], codes[order], score[order]

    def probes(self, dim: int, q: np.ndarray, fit: Fit | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, key) in the order of the sequences, table by table."""
        if fit is None:
            yield np.arange(len(q)), self.keys(dim, 0, np.zeros((len(q), 1)))
            return
        for t, (a, b) in enumerate(self.projections(dim, fit.hashes)):
            at = q @ a / fit.width + b
            for i in range(0, len(q), 64):
                own, codes, _ = self.sequence(at[i : i + 64], fit.depth)
                yield own + i, self.keys(dim, t, codes)

    def fit(self, sample: np.ndarray, n: int, q: np.ndarray, owner: np.ndarray, near: np.ndarray) -> Fit:
        """The cheapest of the choices for n vectors. owner: the query (row of q) of each row of near, its true neighbours."""
        spread = float(np.sqrt(np.mean((sample - sample.mean(axis=0)) ** 2) * sample.shape[1])) or 1.0
        reach = self.reach * float(np.sqrt(((near - q[owner]) ** 2).sum(axis=1)).max(initial=0))
        found = []
        for hashes in self.choices:
            width = self.width * spread
            scores, of_sample, at_all = [], [], []
            for a, b in self.projections(sample.shape[1], hashes):
                at = q @ a / width + b
                scores.append((self.gaps(at[owner], np.floor(near @ a / width + b)) ** 2).sum(axis=1))
                codes = np.floor(sample[:1024] @ a / width + b)
                of_sample.append((self.gaps(at[:32, None], codes[None]) ** 2).sum(axis=2))
                at_all.append(at[:32])
            least = np.min(scores, axis=0)
            depth = float(np.quantile(least, self.target_recall, method="higher")) if len(least) else 0.0
            probes = sum(self._count(at, depth) for at in at_all)
            rows = sum(float((s <= depth).mean()) for s in of_sample) * n
            found.append((probes * self.probe_cost + rows, Fit(hashes, width, depth, reach)))
        return min(found, key=lambda f: f[0])[1]

    def _count(self, at: np.ndarray, depth: float, steps: int = 128) -> float:
        """About how many buckets a query's sequence has, on average, without listing them."""
        if depth <= 0:
            return 1.0
        reach, total = int(np.ceil(np.sqrt(depth))) + 1, 0.0
        for row in at:
            ways = np.zeros(steps + 1)
            ways[0] = 1
            for p in row:
                new = np.zeros(steps + 1)
                for step in range(-reach, reach + 1):
                    cost = int(np.ceil(float(self.gaps(p, np.floor(p) + step)) ** 2 / depth * steps - 1e-9))
                    if cost <= steps:
                        new[cost:] += ways[: steps + 1 - cost]
                ways = new
            total += ways.sum()
        return total / len(at)

    def compare(self, rows: DataFrame, queries: dict[int, tuple], with_x: bool = False) -> DataFrame:
        """The k nearest rows of each query, in every task: queries has, by length, ids, hashes and vectors; a bounded number, which is broadcast."""
        shared = rows.sparkSession.sparkContext.broadcast(queries)

        def run(batches):
            found = Found(self.k, with_x)
            for dim, ids, x in blocks(batches, 8 << 20):
                if dim in shared.value:
                    q_ids, q_hashes, q = shared.value[dim]
                    x = x.astype(np.float64)
                    for i in range(0, len(x), 4096):
                        for j in range(0, len(q), 512):
                            found.add(x[i : i + 4096], ids[i : i + 4096], np.ones(len(x[i : i + 4096]), np.int64), q[j : j + 512], q_ids[j : j + 512], q_hashes[j : j + 512])
            yield from found.batches()

        return rows.mapInArrow(run, _NEAR)

    def _top(self, near: DataFrame, *more: str) -> DataFrame:
        """The k best of each query, with their ranks."""
        once = near.groupBy("query_id", "qh", "vec_id", "score").agg(*[F.first(c).alias(c) for c in more] or [F.count("*").alias("n")])
        by = Window.partitionBy("query_id", "qh").orderBy("score", "vec_id")
        return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= self.k)

    def fits(self, rows: DataFrame) -> dict[int, Fit]:
        """By length of vectors; lengths with few rows have none."""
        sized = rows.withColumn("dim", F.size("v"))
        counts = {r.dim: r.n for r in sized.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") >= self.few).collect()}
        if not counts:
            return {}
        by = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v")
        drawn = sized.filter(F.col("dim").isin(list(counts))).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= self.sample).drop("r").collect()
        drawn.sort(key=lambda r: (r.vec_id, r.v))
        samples: dict[int, tuple] = {}
        for dim in counts:
            own = [r for r in drawn if r.dim == dim]
            x = np.array([r.v for r in own], np.float64)
            at = np.random.default_rng(self.seed).permutation(len(own))
            samples[dim] = (np.array([r.vec_id for r in own], np.int64)[at], x[at])
        asked = {dim: (ids[: self.sample_queries], np.arange(len(ids[: self.sample_queries])), x[: self.sample_queries]) for dim, (ids, x) in samples.items()}
        out = {}
        truth = self._top(self.compare(rows, asked, with_x=True), "x").select("qh", "x").collect()
        for dim, (_, x) in samples.items():
            own = [r for r in truth if len(r.x) == 8 * dim]
            near = np.array([np.frombuffer(r.x, "<f8") for r in own]).reshape(-1, dim)
            out[dim] = self.fit(x, counts[dim], asked[dim][2], np.array([r.qh for r in own], np.int64), near)
        return out

    def search(self, embeddings: DataFrame, every: int = 100) -> DataFrame:
        """query_id, rank, vec_id, score: the nearest found of each vector whose vec_id is divisible by `every`."""
        kept = "float" if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "double"
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kept}>").alias("v")).filter(
            F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
        )
        kind = "<f4" if kept == "float" else "<f8"
        fits = self.fits(rows)
        near = materialize(self.probed(rows, fits, every, kind), "near")
        return self._top(near.unionByName(self.exact(rows, fits, near, every, kind))).select("query_id", "rank", "vec_id", "score")

    def probed(self, rows: DataFrame, fits: dict[int, Fit], every: int, kind: str, most_bytes: int = 8 << 20) -> DataFrame:
        """What the tables offer: the k best rows of each query in each task of the join."""
        k = self.k

        def index(batches):
            seq = TaskContext.get().partitionId() << 40
            for dim, ids, x in blocks(batches):
                order = np.lexsort((ids, hashes_of(x)))  # equal vectors next to each other, ids ascending
                ids, x = ids[order], x[order]
                new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
                group = np.cumsum(new) - 1
                kept = np.r_[True, (ids[1:] != ids[:-1]) | new[1:]]
                ids, group = ids[kept], group[kept]
                first = np.r_[True, group[1:] != group[:-1]]
                rank = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
                ids, group, x = ids[rank <= k], group[rank <= k], x[new].astype(kind)
                counts = np.bincount(group, minlength=len(x))
                starts = np.cumsum(counts) - counts
                for keys in self.entries(dim, x.astype(np.float64), fits.get(dim)):
                    by = np.argsort(keys, kind="stable")
                    out: list[list] = [[], [], [], [], [], []]
                    for run in np.split(by, np.flatnonzero(np.diff(keys[by])) + 1):
                        for i in range(0, len(run), self.pack):
                            own = run[i : i + self.pack]
                            held = np.concatenate([ids[starts[e] : starts[e] + counts[e]] for e in own])
                            seq += 1
                            for c, v in zip(out, (keys[own[0]], seq, dim, held.astype("<i8").tobytes(), counts[own].astype("<i4").tobytes(), x[own].tobytes()), strict=True):
                                c.append(v)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["key", "chunk", "dim", "ids", "counts", "x"])

        def ask(batches):
            seq = TaskContext.get().partitionId() << 40
            for dim, ids, q in blocks(batches, 4 << 20):
                qh, q = hashes_of(q), q.astype(kind)
                who, where = [], []
                for own, keys in self.probes(dim, q.astype(np.float64), fits.get(dim)):
                    who.append(own)
                    where.append(keys)
                who, where = np.concatenate(who), np.concatenate(where)
                by = np.argsort(where, kind="stable")
                out: list[list] = [[], [], [], []]
                held, kinds = 0, (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["key", "block", "q", "q_x"])  # noqa: E731, B023
                for run in np.split(by, np.flatnonzero(np.diff(where[by])) + 1):
                    for i in range(0, len(run), self.pack):
                        own = who[run[i : i + self.pack]]
                        seq += 1
                        for c, v in zip(out, (where[run[0]], seq, np.stack([ids[own], qh[own]], axis=1).astype("<i8").tobytes(), q[own].tobytes()), strict=True):
                            c.append(v)
                        held += len(own) * (16 + q[0].nbytes)
                        if held >= most_bytes:  # a block's probes are many times its queries
                            yield batch(out)
                            out, held = [[], [], [], []], 0
                yield batch(out)

        asked = self.queries(rows, every)
        tasks = max(1, -(-asked.count() // 4096))  # so that a probed bucket meets few blocks of queries
        # a query has many probes, which Spark takes for one row: without the hint it would gather them all on the driver
        probes = asked.repartition(tasks).mapInArrow(ask, "key long, block long, q binary, q_x binary").hint("merge")
        met = rows.mapInArrow(index, "key long, chunk long, dim int, ids binary, counts binary, x binary").join(probes, "key").select("key", "dim", "chunk", "ids", "counts", "x", "block", "q", "q_x")

        def run(batches):
            found = Found(k)
            for batch in batches:
                keys = batch.column("key").to_numpy()
                chunks, asks = batch.column("chunk").to_numpy(), batch.column("block").to_numpy()
                # the chunks and blocks of a bucket stand in all pairs: they are compared at once
                for own in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                    if not len(own):
                        continue
                    dim = batch.column("dim")[int(own[0])].as_py()
                    xs, qs = ([int(own[e]) for e in np.unique(c[own], return_index=True)[1]] for c in (chunks, asks))
                    raw = lambda c, at: b"".join(batch.column(c)[i].as_buffer().to_pybytes() for i in at)  # noqa: E731, B023
                    x = np.frombuffer(raw("x", xs), kind).reshape(-1, dim).astype(np.float64)
                    q = np.frombuffer(raw("q_x", qs), kind).reshape(-1, dim).astype(np.float64)
                    ids, counts = np.frombuffer(raw("ids", xs), "<i8"), np.frombuffer(raw("counts", xs), "<i4").astype(np.int64)
                    who = np.frombuffer(raw("q", qs), "<i8").reshape(-1, 2)
                    starts = np.r_[0, np.cumsum(counts)]
                    for i in range(0, len(x), 4096):
                        j = min(i + 4096, len(x))
                        for m in range(0, len(q), 512):
                            found.add(x[i:j], ids[starts[i] : starts[j]], counts[i:j], q[m : m + 512], who[m : m + 512, 0], who[m : m + 512, 1])
            yield from found.batches()

        return met.mapInArrow(run, _NEAR).select("query_id", "qh", "vec_id", "score")

    @staticmethod
    def queries(rows: DataFrame, every: int) -> DataFrame:
        return rows.filter(F.col("vec_id") % every == 0)

    def exact(self, rows: DataFrame, fits: dict[int, Fit], near: DataFrame, every: int, kind: str, most_bytes: int = 32 << 20) -> DataFrame:
        """The last step: queries that hold fewer than k rows, or rows beyond the reach of the fit, against all rows of their length."""
        held = self._top(near).groupBy("query_id", "qh").agg(F.count("*").alias("n"), F.max("score").alias("worst")).filter(F.col("n") >= self.k)

        def hashed(batches):
            for dim, ids, x in blocks(batches, 1 << 20):
                if dim in fits:  # other lengths have been searched in full
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes_of(x)), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64())), pa.array(np.full(len(ids), fits[dim].reach))], names=["query_id", "qh", "v", "reach"])

        asked = self.queries(rows, every).mapInArrow(hashed, "query_id long, qh long, v array<double>, reach double")
        lacking = asked.join(held, ["query_id", "qh"], "left").filter(F.col("worst").isNull() | (F.col("worst") > F.col("reach")))
        lacking = materialize(lacking.select("query_id", "qh", "v").dropDuplicates(["query_id", "qh"]), "lacking")
        size = lacking.agg(F.coalesce(F.sum(F.size("v").cast("long") * 8 + 64), F.lit(0))).first()[0]
        passes = -(-size // most_bytes)
        out = near.limit(0)
        for i in range(passes):
            own = lacking.filter(F.pmod(F.xxhash64("query_id", "qh"), F.lit(passes)) == i).toArrow()  # about `most_bytes`
            dims = pc.list_value_length(own["v"])
            block = {}
            for dim in dims.unique().to_pylist():
                ids, qh, v = (c.combine_chunks() for c in own.filter(pc.equal(dims, dim)).select(["query_id", "qh", "v"]).columns)
                block[dim] = (ids.to_numpy(), qh.to_numpy(), v.flatten().to_numpy().reshape(-1, dim))
            out = out.unionByName(self.compare(rows, block).select("query_id", "qh", "vec_id", "score"))
        return out
