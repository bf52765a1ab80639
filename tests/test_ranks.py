"""Exact quantiles by rank selection against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxspan.operators import ranks, stats


def rows_of(seed):
    rng = random.Random(seed)
    pick = [lambda: rng.gauss(0, 1), lambda: rng.choice([0.0, -0.0, 1.0, -1.0]), lambda: rng.choice([1e-320, -1e308, 1e308, 5e-324, 2.5]), lambda: rng.choice([None, math.nan, math.inf, -math.inf, 3.25])]
    return [(rng.choice(["a", "b", None]), rng.choice(pick)(), rng.randint(1, 5)) for _ in range(700)] + [("only", None, 1), ("one", 7.5, 2)]


def finite(v):
    return v is not None and math.isfinite(v)


@pytest.mark.parametrize("few", [10**6, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles(spark, monkeypatch, few, seed):
    monkeypatch.setattr(ranks, "FEW", few)  # 0: all passes
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5)
    shares = {"lo": 0.0, "p05": 0.05, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    wanted = {n: (F.col("v"), p) for n, p in shares.items()} | {"sq": (F.col("v") + F.col("v"), 0.5)}
    got = {r.g: r for r in ranks.grouped(df, ["g"], [F.count("*").alias("n")], wanted).collect()}
    weighted = {r.g: r for r in ranks.quantiles(df, ["g"], {"mid": (F.col("v"), 0.5)}, "n").collect()}
    assert set(got) == {"a", "b", None, "only", "one"} and got["only"].mid is None and "only" not in weighted
    for g in ("a", "b", None, "one"):
        own = [(v, n) for k, v, n in rows if k == g and finite(v)]
        for n, p in shares.items():
            assert math.isclose(got[g][n], np.quantile([v for v, _ in own], p), rel_tol=1e-9, abs_tol=1e-300), (g, n)
        doubled = [2 * v for v, _ in own if math.isfinite(2 * v)]
        assert math.isclose(got[g].sq, np.quantile(doubled, 0.5), rel_tol=1e-9, abs_tol=1e-300)
        assert math.isclose(weighted[g].mid, np.quantile(np.repeat([v for v, _ in own], [n for _, n in own]), 0.5), rel_tol=1e-9, abs_tol=1e-300)
    assert ranks.quantiles(df.limit(0), ["g"], {"mid": (F.col("v"), 0.5)}).count() == 0


def test_one_large_group(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    q = {"a": (F.col("v"), 0.25), "m": (F.col("v"), 0.5), "z": (F.col("v"), 0.999)}
    out = ranks.quantiles(df, ["g"], q)
    assert "ercentile" not in out._jdf.queryExecution().toString()
    got = out.first()
    assert (got.a, got.m, got.z) == tuple(np.quantile(np.arange(n), p) for p in (0.25, 0.5, 0.999))


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    """Beyond the limit a table of groups meets the rows in a shuffle, with the same result."""
    rows = spark.range(3000).select((F.col("id") % 300).alias("g"), F.when(F.col("id") < 300, 1e6).otherwise((F.col("id") * 37 % 101).cast("double")).alias("v"))
    want = sorted(map(tuple, stats.sigma_clip_stats(rows, ["g"], "v", 2.0, 3).collect()))
    few = spark.range(5).toDF("g")
    plan = lambda n: rows.join(ranks.small(few, n), "g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(5) and "BroadcastHashJoin" not in plan(ranks.BROADCAST_ROWS + 1)
    joins = []
    monkeypatch.setattr(stats, "written", lambda df, w=stats.written: joins.append(df._jdf.queryExecution().executedPlan().toString()) or w(df))
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 100)
    assert sorted(map(tuple, stats.sigma_clip_stats(rows, ["g"], "v", 2.0, 3).collect())) == want
    assert joins and not any("BroadcastHashJoin" in p for p in joins)


def test_medians_of_packed_values(spark, monkeypatch):
    """Chunks of sorted values with a weight, some empty, against numpy; only values near the middle become rows."""
    rng = np.random.default_rng(4)
    chunks, every = [], {}
    for g, k in (("a", 1), ("a", 2), ("ties", 1), ("same", 1), ("two", 1), ("none", 1)):
        for c in range(1 if g == "two" else 5):
            some = {"a": rng.exponential(3.0, 4000 + c), "ties": rng.integers(0, 3, 500).astype(float), "same": np.zeros(7), "two": np.array([1e-300, 1e300]), "none": np.zeros(0)}[g]
            chunks.append((g, k, c % 2 + 1, len(some) + 1, bytearray(np.sort(some).tobytes())))
            every.setdefault((g, k), []).append((len(some) + 1, c % 2 + 1, some))
    df = spark.createDataFrame(chunks, "g string, k int, w int, n long, v binary").repartition(3)
    stored = []
    monkeypatch.setattr(ranks, "written", lambda df, w=ranks.written: (t := w(df), stored.append(t.count()))[0])
    got = {(r.g, r.k): r for r in ranks.packed_medians(df, ["g", "k"]).collect()}
    assert got.keys() == every.keys() and got["none", 1].power is None
    for key, each in every.items():
        assert got[key].n == sum(n * w for n, w, _ in each)
        if key[0] != "none":
            assert math.isclose(got[key].power, np.median(np.concatenate([np.repeat(v, w) for _, w, v in each])), rel_tol=1e-14)
    assert max(stored) < 2000
