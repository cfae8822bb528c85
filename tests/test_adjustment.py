"""The three adjustments of a network in one pass a step, and the merge of tie files."""

import random

import pytest

from pyspark.sql import functions as F

from traceflow.operators import ties
from traceflow.sources import files

TIES = "line_a long, trc_a long, line_b long, trc_b long, zdiff double, phasediff double, ampdiff double, quality double"


@pytest.mark.parametrize("widest", [60.0, 900.0])
def test_adjusted_together(spark, monkeypatch, widest):
    """As one after another, also where phases turn; where none turns, ties are written once for all three and corrections once a step."""
    draw = random.Random(6)
    rows = [(a, i, b, i, draw.uniform(-9, 9), draw.uniform(-widest, widest) if i % 9 else None, draw.uniform(0.2, 3), draw.uniform(0.3, 1)) for i in range(40) for a, b in [sorted(draw.sample(range(8), 2))]]
    df, calls, real = spark.createDataFrame(rows, TIES), [], ties.saved
    monkeypatch.setattr(ties, "saved", lambda *a: calls.append(1) or real(*a))
    got = {r.line: (r.shift, r.phase, r.amp) for r in ties.adjust_all(df, [1], 0.5, 4, 0.75, None).collect()}
    if widest < 100:
        assert len(calls) == 4 + 2
    z, p = (ties.adjust(df, c, [1], 0.5, 4, 0.75, phase=c == "phasediff") for c in ("zdiff", "phasediff"))
    log = df.withColumn("l", F.log10("ampdiff"))
    a = ties.adjust(log, "l", [1], 0.5, 4, 0.75, start=ties.start_values(df, [1], ties.amplitude_start(df, [1])))
    want = [{r.line: r.c for r in x.collect()} for x in (z, p, a)]
    assert got.keys() == want[2].keys()
    for line, (shift, phase, amp) in got.items():
        assert abs(shift - want[0].get(line, 0)) < 1e-9 and abs(phase - want[1].get(line, 0)) < 1e-9 and abs(amp - 10 ** want[2][line]) < 1e-9


def test_merge_of_compressed_files(spark, tmp_path):
    """Tie files may be compressed; a merge shuffles a tie once, without its key beside it."""
    rows = [(str(a), i, str(b), i, float(i), 0.0, float(a - b), 10.0 * i, 1.5, 0.9) for i in range(4) for a, b in ((1, 2), (3, 2), (10, 9))]
    df = spark.createDataFrame(rows, "line_a string, trc_a long, line_b string, trc_b long, x double, y double, zdiff double, phasediff double, ampdiff double, quality double")
    files.write_ties(df, f"{tmp_path}/t", "gzip")
    names = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("part")]
    assert names and all(n.endswith(".csv.gz") for n in names)
    got = files.merge_ties(files.read_ties(spark, f"{tmp_path}/t"), f"{tmp_path}/t")
    assert got.count() == 12
    assert "least(" not in got._jdf.queryExecution().executedPlan().toString()
