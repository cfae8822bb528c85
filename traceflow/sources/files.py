"""Files of ties, corrections, wavelets and export layers, by Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceflow.operators.ties import upsert

#: Column names of a tie file, in order (fixed values of its format).
TIE_COLUMNS = ["LineA", "TrcA", "LineB", "TrcB", "X", "Y", "Zdiff", "PhaseDiff", "AmpDiff", "Quality"]
TIE_SCHEMA = "LineA string, TrcA long, LineB string, TrcB long, X double, Y double, Zdiff double, PhaseDiff double, AmpDiff double, Quality double"
OURS = ["line_a", "trc_a", "line_b", "trc_b", "x", "y", "zdiff", "phasediff", "ampdiff", "quality"]


def read_ties(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated tie file with a quoted header."""
    df = spark.read.csv(path, sep="\t", header=True, schema=TIE_SCHEMA)
    return df.toDF(*OURS)


def write_ties(df: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of tie files; compressed ones (gzip, say) are read back by their endings."""
    df.select(*OURS).toDF(*TIE_COLUMNS).write.csv(path, sep="\t", header=True, quoteAll=False, compression=compression)


def merge_ties(old: DataFrame, path: str, merge: bool = True, replace: bool = True, order: list[str] | None = None) -> DataFrame:
    """old with the ties of a file (or a folder of files), oriented, one row per crossing. Without merge old's rows go first; with it, of a crossing
    in both the file's row stays if replace, else old's. order: columns that decide between rows of one crossing in one table."""
    new = read_ties(old.sparkSession, path)
    return upsert((old if merge else old.limit(0)).select(*OURS), new, replace, order or ["x", "y", "zdiff", "phasediff", "ampdiff"])


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Lines `name: shift`phase`amp`; lines without a name are skipped."""
    t = spark.read.text(path)
    name = F.trim(F.substring_index("value", ":", 1))
    number = lambda i, default: F.coalesce(F.expr(f"try_cast(trim(get(split(substring(value, instr(value, ':') + 1), '`'), {i})) AS double)"), F.lit(default))
    return t.where(F.instr("value", ":") > 1).select(name.alias("line"), number(0, 0.0).alias("shift"), number(1, 0.0).alias("phase"), number(2, 1.0).alias("amp")).where("line <> ''")


def write_corrections(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.col("line"), F.lit(": "), F.concat_ws("`", *[F.col(c).cast("string") for c in ("shift", "phase", "amp")])).alias("value")).write.text(path)


def read_wavelet(spark: SparkSession, path: str, skip: int = 9) -> DataFrame:
    """seq, value: the numbers of a small wavelet file after its header lines; `!` starts a comment."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("seq", "s"))
    v = F.expr("try_cast(trim(split(s, '!')[0]) AS double)")
    return t.where(F.col("seq") >= skip).select("seq", v.alias("value")).where("value is not null")


def write_horizon(df: DataFrame, path: str, name: str) -> None:
    """A gridded or corrected horizon(ix, iy, z), under its name; undefined nodes are left out. A horizon of that name is replaced."""
    df.where("z is not null").select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("z").cast("double").alias("z")).write.mode("overwrite").parquet(f"{path}/{name}")


def read_horizon(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema("ix long, iy long, z double").parquet(f"{path}/{name}")
