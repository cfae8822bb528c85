"""Crossings of lines, and ties at them, found without a shuffle of the crossings themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceflow import queries
from traceflow.operators import crossings, estimation, ties
from traceflow.operators.spectral import tie_estimate


def zigzag(lines, length, seed, name=int):
    """line, trcnr, x, y: random walks over a few cells, which cross each other more than once near a trace."""
    draw, out = random.Random(seed), []
    for line in range(lines):
        x, y = draw.uniform(0, 6), draw.uniform(0, 6)
        for t in range(length):
            out.append((name(line), t + 1, x, y))
            x, y = x + draw.uniform(-1, 1.5), y + draw.uniform(-1.5, 1)
    return out


def brute(rows):
    legs, out = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        legs.setdefault(r[0], []).append(r[1:])
    for a in legs:
        for b in legs:
            if a < b:
                for (ta, xa, ya), (na, xa2, ya2) in zip(legs[a], legs[a][1:]):
                    for (tb, xb, yb), (nb, xb2, yb2) in zip(legs[b], legs[b][1:]):
                        if None in (xa, ya, xa2, ya2, xb, yb, xb2, yb2):
                            continue
                        dxa, dya, dxb, dyb = xa2 - xa, ya2 - ya, xb2 - xb, yb2 - yb
                        den = dyb * dxa - dxb * dya
                        if abs(den) <= 1e-12:
                            continue
                        u, v = (dxb * (ya - yb) - dyb * (xa - xb)) / den, (dxa * (ya - yb) - dya * (xa - xb)) / den
                        if 0 <= u <= 1 and 0 <= v <= 1:
                            key = (a, ta if u < 0.5 else na, b, tb if v < 0.5 else nb)
                            at = (xa + u * dxa, ya + u * dya)
                            out[key] = min(out.get(key, at), at)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block, cell, name", [(512, 4.0, int), (3, 1.0, int), (5, 0.7, "line {}".format)])
def test_crossings_brute(spark, monkeypatch, block, cell, name):
    monkeypatch.setattr(crossings, "BLOCK", block)
    rows = zigzag(14, 12, 3, name)
    rows[20] = (*rows[20][:2], None, rows[20][3])
    st = spark.createDataFrame(rows, f"line {'long' if name is int else 'string'}, trcnr long, x double, y double")
    found = ties.line_crossings(st, cell).collect()
    want = brute(rows)
    got = {tuple(r)[:4]: (r.x, r.y) for r in found}
    assert len(found) == len(got) > 50 and got.keys() == want.keys()
    assert all(math.dist(got[k], want[k]) < 1e-12 for k in want)


def test_crossings_are_not_shuffled(spark):
    st = spark.createDataFrame(zigzag(4, 5, 1), "line long, trcnr long, x double, y double")
    assert "hashpartitioning(line_a" not in plan(ties.line_crossings(st))


def test_horizon_ties_at_crossings(spark):
    rows = zigzag(9, 10, 5)
    st = spark.createDataFrame(rows, "line long, trcnr long, x double, y double")
    h = spark.createDataFrame([(r[0], r[1], None if i % 7 == 2 else i * i / 3) for i, r in enumerate(rows) if i % 11], "line long, trcnr long, z double")
    got = ties.line_horizon_ties(st, h, 2.0)
    want = ties.horizon_ties(h, ties.line_crossings(st), 2.0)
    key = ["line_a", "trc_a", "line_b", "trc_b", "zdiff"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect())) and got.where("zdiff <> 0").count() > 5


def test_horizon_queries_do_not_shuffle_crossings(spark):
    for name in ("mistie_horizon_2d", "mistie_horizon_all"):
        assert "hashpartitioning(line_a" not in plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_pair_estimates():
    """Pairs of few traces, each with one spectrum, as the traces of each pair on their own; lags beyond the traces, traces without energy and of one sample too."""
    rng = np.random.default_rng(4)
    for n, longest in ((33, 0.03), (8, 0.2), (1, 0.01)):
        x, y = rng.normal(size=(6, n)), rng.normal(size=(7, n))
        x[2], y[5] = 0, 0
        p, q = np.repeat(np.arange(6), 7), np.tile(np.arange(7), 6)
        for z_only, other in ((False, tie_estimate), (True, estimation.shift_estimate)):
            got, want = estimation.pair_estimates(x, y, p, q, 0.004, longest, z_only, rows=5), other(x[p], y[q], 0.004, longest)
            for v in estimation.VALUES:
                assert np.allclose(got[v], want[v][:, 0], atol=1e-9), (n, z_only, v)


def test_ties_by_traces_at_crossings(spark):
    """The ties of a join of crossings and traces: steps, beginnings and lengths differ, some traces are absent, undefined or not exact in four bytes."""
    rng, rows = np.random.default_rng(8), zigzag(9, 10, 5)
    kinds = [(0.0, 0.004, 64), (0.0, 0.008, 32), (0.02, 0.004, 40), (float("nan"), 0.004, 64)]
    held = []
    for i, r in enumerate(rows):
        z0, step, n = kinds[i % 19 % 4]
        x = rng.normal(size=n)
        samples = None if i % 13 == 5 else [None if k == 7 and i % 5 == 1 else float(np.float32(v)) if i % 2 else float(v) for k, v in enumerate(x)]
        held += [(r[0], r[1], z0, step, samples)] * (i % 12 != 3)
    st = spark.createDataFrame(rows, "line long, trcnr long, x double, y double")
    traces = spark.createDataFrame(held, "line long, trcnr long, z0 double, step double, samples array<double>")
    side = lambda t: traces.select(*[F.col(c).alias(n) for c, n in (("line", f"line_{t}"), ("trcnr", f"trc_{t}"))], *[F.col(c).alias(f"{t}_{c}") for c in ("samples", "z0", "step")])
    key = ["line_a", "trc_a", "line_b", "trc_b"]
    for z_only in (False, True):
        pairs = ties.line_crossings(st).join(side("a"), key[:2], "left").join(side("b"), key[2:], "left")
        want = {tuple(r)[:4]: tuple(r)[4:8] for r in estimation.estimated(pairs, key, (0.02, 0.2), 0.03, z_only, 1000.0).collect()}
        found = estimation.lines_by_traces(st, traces, (0.02, 0.2), 0.03, z_only, 1000.0)
        got = {tuple(r)[:4]: tuple(r)[6:] for r in found.collect()}
        assert got.keys() == want.keys() and sum(v[3] > 0 for v in got.values()) > 5 and sum(v == (0, 0, 1, 0) for v in got.values()) > 3
        assert all(np.allclose(got[k], want[k], atol=1e-7) for k in want)
        assert "hashpartitioning(line_a" not in plan(found)


@pytest.mark.parametrize("name", ["mistie_estimate_2d", "mistie_estimate_all", "mistie_estimate_z"])
def test_estimate_queries_do_not_shuffle_crossings(spark, name):
    assert "hashpartitioning(line_a" not in plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
