"""The data model over the driver tables. A trace is one row with an array of samples, so that whatever looks along a
trace needs no shuffle; sample form (one row a sample) is made at the end, where a result asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(first: int, n: int) -> Column:
    return F.transform(F.slice("embedding", first + 1, n), lambda x: x.cast("double"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, inl, crl, samples (64): a lattice of 25 crosslines."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 25).cast("long").alias("inl"), (F.col("vec_id") % 25).alias("crl"), _part(0, 64).alias("samples"))


def intercept_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, inl, crl, a, b: two traces of 32 samples each."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 25).cast("long").alias("inl"), (F.col("vec_id") % 25).alias("crl"), _part(0, 32).alias("a"), _part(32, 32).alias("b"))


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, s1..s4: four angle stacks of 16 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", *[_part(16 * i, 16).alias(f"s{i + 1}") for i in range(4)])


def stacks5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, s1..s5: five angle stacks of 13 samples, of which the last two share one."""
    return table(spark, sf_dir, "embeddings").select("vec_id", *[_part(first, 13).alias(f"s{i + 1}") for i, first in enumerate((0, 13, 26, 39, 51))])


def stations2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, trcnr, x, y, z: the lines of horizon2d on a map, even ones across the odd ones."""
    even, slot, t = F.col("line") % 2 == 0, F.floor(F.col("line") / 2) % 40 + 0.5, F.col("trcnr")
    x, y = F.when(even, t + 0.25).otherwise(slot - 0.03 * t), F.when(even, slot + 0.05 * t).otherwise(t + 0.25)
    return horizon2d(spark, sf_dir).select("line", "trcnr", x.alias("x"), y.alias("y"), "z")


def line_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, trcnr, samples: a trace for each station of horizon2d, one of the volume's."""
    t = traces(spark, sf_dir).select("vec_id", "samples")
    n = t.agg((F.max("vec_id") + 1).alias("n"))
    at = horizon2d(spark, sf_dir).crossJoin(F.broadcast(n)).select("line", "trcnr", ((F.col("line") * 31 + F.col("trcnr")) % F.col("n")).alias("vec_id"))  # one row
    return at.join(t, "vec_id").select("line", "trcnr", "samples")


def samples(df: DataFrame, *arrays: str, keys: tuple = ("vec_id",)) -> DataFrame:
    """Sample form: keys, z and a column per array; arrays of one trace are of one length."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("z", "__s")).select(*keys, F.col("z").cast("long").alias("z"), *[F.col(f"__s.{a}").alias(a) for a in arrays])


def horizon2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, trcnr, z: the events of a user in time, as a horizon along a line."""
    from pyspark.sql import Window

    nr = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), nr.cast("long").alias("trcnr"), F.col("value").cast("double").alias("z"))


def misties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_a, trc_a, line_b, trc_b, zdiff, phasediff, ampdiff, quality: suppliers of one order as crossing lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", "l_extendedprice", "l_discount")])
    a, b = (li.select(*[F.col(c).alias(f"{s}_{c}") for c in li.columns]) for s in "ab")
    j = a.join(b, (F.col("a_l_orderkey") == F.col("b_l_orderkey")) & (F.col("a_l_suppkey") < F.col("b_l_suppkey")))
    return j.select(
        F.col("a_l_orderkey").alias("okey"),
        F.col("a_l_suppkey").alias("line_a"),
        F.col("a_l_linenumber").cast("long").alias("trc_a"),
        F.col("b_l_suppkey").alias("line_b"),
        F.col("b_l_linenumber").cast("long").alias("trc_b"),
        (F.col("a_l_quantity") - F.col("b_l_quantity")).alias("zdiff"),
        (1000 * (F.col("a_l_tax") - F.col("b_l_tax"))).alias("phasediff"),
        (F.col("a_l_extendedprice") / F.col("b_l_extendedprice")).alias("ampdiff"),
        (1 - 5 * F.abs(F.col("a_l_discount") - F.col("b_l_discount"))).alias("quality"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, v: scattered values."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y"), F.col("c_acctbal").cast("double").alias("v"))


#: Edges of two fault polylines: fault, seq, x1, y1, x2, y2.
FAULTS = [(1, 1, 10.5, -5.0, 30.2, 40.3), (1, 2, 30.2, 40.3, 20.7, 95.1), (2, 1, 60.3, 10.4, 80.6, 70.2)]
