"""What several operators share: the cluster's shared folder, written stages, and numpy text kernels.

The kernels take whole Arrow string columns: one uint8 buffer and the texts'
offsets. They run inside mapInArrow or applyInArrow tasks.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel looks at together (one longer text is taken alone).
SLICE_BYTES = 1 << 21
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset, local sessions get a folder of this process, clusters an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/traceflow/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, survives lost executors,
    and lets Spark drop the shuffle files of the finished write."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column, to size partitions by."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first().b


def spread(docs: DataFrame) -> DataFrame:
    """docs in a partition for each core, where it comes in fewer files than there are cores: what follows without a shuffle then uses all of them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def fan_out(total_bytes: int, each: int, least: int = 64) -> int:
    """How many groups of about `each` bytes hold total_bytes."""
    return max(least, -(-total_bytes // each))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd uint64 multipliers that every worker derives alike."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_POWERS = constants(4096, 7)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = constants(1 << int(n - 1).bit_length(), 7)
    return _POWERS


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes each, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Words:
    """Words of texts that run between separators.

    h: a 64-bit hash per word; row: its text; start, end: its bytes; first: of each text, the index of its first word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        rows = len(offsets) - 1
        space = (data == 32) | ((data >= 9) & (data <= 13))
        begins = ~space
        begins[1:] &= space[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = ~space[heads]
        self.start = np.flatnonzero(begins)
        stops = np.zeros(n + 1, bool)
        stops[1:] = ~space
        stops[1:n] &= space[1:]
        if n:
            cuts = offsets[1:][offsets[:-1] < offsets[1:]]
            stops[cuts] = ~space[cuts - 1]
        self.end = np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        if len(self.start):
            length = self.end - self.start
            at = np.arange(n) - np.repeat(self.start, np.diff(np.append(self.start, n))) if self.start[0] == 0 else np.concatenate([np.zeros(self.start[0], np.int64), np.arange(self.start[0], n) - np.repeat(self.start, np.diff(np.append(self.start, n)))])
            at[space] = 0
            p = powers(int(length.max()) + 1)
            value = (data.astype(np.uint64) + np.uint64(1)) * p[at]
            value[space] = 0
            self.h = mix(np.add.reduceat(value, self.start) + length.astype(np.uint64))
        else:
            self.h = np.zeros(0, np.uint64)


def grams(h: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """A hash for each run of k neighbours in h (len(h) - k + 1 of them; texts' borders aren't looked at)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = constants(k, seed)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * m[i]
    return mix(out)


#: Low bits of a key that hold its place in sliding_argmin: the same for every array, so that equal contents choose alike.
PLACE_BITS = 28


def sliding_argmin(key: np.ndarray, w: int) -> np.ndarray:
    """For each run of w neighbours, the place of its smallest key (by the bits above PLACE_BITS), the leftmost of equals."""
    n = len(key)
    if n < w:
        return np.zeros(0, np.int64)
    if n >> PLACE_BITS:
        raise ValueError("one text is too long")
    low = np.uint64((1 << PLACE_BITS) - 1)
    cur = (key & ~low) | np.arange(n, dtype=np.uint64)
    have = 1
    while 2 * have <= w:
        cur = np.minimum(cur[: len(cur) - have], cur[have:])
        have *= 2
    if have < w:
        cur = np.minimum(cur[: n - w + 1], cur[w - have : w - have + n - w + 1])
    return (cur & low).astype(np.int64)


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> list[list]:
    """Rows [bucket, blob of each column] of columns dealt by bucket."""
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    cuts = np.append(first, len(bucket))
    return [[int(k), *[c[order[cuts[i] : cuts[i + 1]]].tobytes() for c in columns]] for i, k in enumerate(keys)]


def blobs(table: pa.Table, name: str, dtype: type = np.uint64) -> np.ndarray:
    """All values of a column of blobs, one after another; nulls are skipped."""
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype)


def int64s(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
