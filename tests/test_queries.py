"""Every registered query of the library against its SQL at sf0.001, and the golden vectors of the array functions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from traceflow.functions import arrays as A
from traceflow.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    def value(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (int, np.integer)) else str(x)

    return sorted(str([value(x) for x in row]) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


# The published test vectors of the paddings and the spectrum's shift.
@pytest.mark.parametrize(
    "fn,values,want",
    [
        (A.mirror_pad, range(1, 8), [3, 2, 1, 1, 2, 3, 4, 5, 6, 7, 7, 6, 5, 4]),
        (A.mirror_pad, range(1, 7), [3, 2, 1, 1, 2, 3, 4, 5, 6, 6, 5, 4]),
        (A.symmetric_pad, range(1, 8), [4, 3, 2, 1, 2, 3, 4, 5, 6, 7, 6, 5, 4, 3]),
        (A.symmetric_pad, range(1, 7), [4, 3, 2, 1, 2, 3, 4, 5, 6, 5, 4, 3]),
        (A.fft_shift, range(1, 7), [4, 5, 6, 1, 2, 3]),
        (A.fft_shift, range(1, 8), [5, 6, 7, 1, 2, 3, 4]),
    ],
)
def test_golden(spark, fn, values, want):
    df = spark.createDataFrame([([float(v) for v in values],)], "s array<double>")
    assert df.select(fn(F.col("s")).alias("v")).first().v == want
