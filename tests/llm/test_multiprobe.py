"""Multiprobe search against all distances: near uniform, clustered, outlying and repeated vectors, and its parts."""

import collections
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from reviewloom.llm import multiprobe


def stored(spark, tmp_path, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/e.parquet")
    return spark.read.parquet(f"{tmp_path}/e.parquet")


def searched(df, **options):
    got = collections.defaultdict(list)
    for r in multiprobe.MultiProbe(**options).search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    return got


def recall(got, x, queries, k=10):
    hit, x = 0, x.astype(np.float32).astype(float)
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:k]
        assert len(got[q]) == min(k, len(x) - 1)
        assert got[q] == sorted(got[q])
        assert all(s == d[i] for s, i in got[q])
        hit += len(set(want.tolist()) & {i for _, i in got[q]})
    return hit / (k * len(queries))


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_recall_on_fifty_thousand(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50_000, 32))
    if kind == "clusters":
        x = rng.normal(size=(2000, 32))[rng.integers(0, 2000, 50_000)] + 0.1 * x
    x[49_000:49_400] = x[100]  # a group of copies
    x[list(range(20_000, 20_300, 100))] *= np.array([3, 10, 40])[:, None]  # outliers
    df = stored(spark, tmp_path, x)
    got = searched(df)
    assert recall(got, x, range(0, 50_000, 100)) >= 0.9
    assert [i for _, i in got[100]] == list(range(49_000, 49_010))
    assert recall(got, x, range(20_000, 20_300, 100)) >= 0.9


def test_clustered_vectors_get_few_candidates(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 32))[rng.integers(0, 500, 20_000)] + 0.05 * rng.normal(size=(20_000, 32))
    own = multiprobe.MultiProbe()
    rows = stored(spark, tmp_path, x).selectExpr("vec_id", "embedding AS v")
    fit = own.fits(rows)[32]
    q = x[::100]
    own_queries = collections.defaultdict(set)
    for (who, probed), keys in zip(own.probes(32, q[:64], fit), own.entries(32, x, fit), strict=True):
        for a in range(64):
            own_queries[a] |= set(np.flatnonzero(np.isin(keys, probed[who == a])).tolist())
    assert np.mean([len(v) for v in own_queries.values()]) < 0.05 * len(x)


def test_only_outliers(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) * (10.0 ** rng.integers(-3, 4, 400))[:, None]
    assert recall(searched(stored(spark, tmp_path, x)), x, range(0, 400, 100)) >= 0.9


def test_sequences_ascend_and_miss_nothing():
    rng = np.random.default_rng(6)
    own = multiprobe.MultiProbe()
    at = rng.normal(size=(5, 3)) * 3
    for depth in (0.0, 0.3, 2.5):
        who, codes, score = own.sequence(at, depth)
        for q in range(5):
            base = np.floor(at[q])
            want = {}
            for step in itertools.product(range(-4, 5), repeat=3):
                code = base + step
                s = (own.gaps(at[q], code) ** 2).sum()
                if s <= depth:
                    want[tuple(code)] = s
            mine = [tuple(c) for c in codes[who == q]]
            assert sorted(mine) == sorted(want)
            assert score[who == q].tolist() == sorted(score[who == q])
            assert [want[c] for c in mine] == pytest.approx(score[who == q])


def test_nearest_keeps_ties():
    x = np.array([[1.0, 0], [0, 1], [-1, 0], [0, -1], [2, 0]])
    qi, xi, d = multiprobe.nearest(x, np.zeros((1, 2)), 2)
    assert sorted(xi.tolist()) == [0, 1, 2, 3]
    assert set(d) == {1.0}


def test_repeated_rows_count_once(spark, tmp_path):
    ids = np.array([0, 0, 0, 100, 100, *range(1, 60), 1, 1])
    x = np.array([[1.0, 0], [1, 0], [0, 2], [1, 0], [1, 0], *([k / 10, 1] for k in range(1, 60)), [0.1, 1], [0.1, 1]])
    got = searched(stored(spark, tmp_path, x, ids))
    assert len(got[100]) == 10
    assert got[100][0] == (0.0, 0)
    assert [v for _, v in got[100]].count(1) <= 1
    assert len(got[0]) == 20  # two vectors of this id, each searched
    assert 0 not in [v for _, v in got[0]]


def test_probes_stay_off_the_driver(spark, tmp_path):
    """A query has many probes: they are neither broadcast nor held whole by a task, and small batches of them find the same."""
    rng = np.random.default_rng(7)
    own = multiprobe.MultiProbe()
    rows = stored(spark, tmp_path, rng.normal(size=(8000, 32))).selectExpr("vec_id", "embedding AS v")
    fits = own.fits(rows)
    found = own.probed(rows, fits, 100, "<f4")
    got = {tuple(r) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    assert {r[0] for r in got} == set(range(0, 8000, 100))
    assert {tuple(r) for r in own._top(own.probed(rows, fits, 100, "<f4", most_bytes=1000)).select("query_id", "qh", "vec_id", "score").collect()} <= got
