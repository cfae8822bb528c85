"""Token-id files with keyed access.

A file set is a Parquet table of shards: raw little-endian ids of many documents, the documents' keys,
and an index: a minimal perfect hash from key to slot, where a slot holds the key's fingerprint, offset and
length. A key is found with one hash evaluation, whatever the number of documents. Shards are written
in ascending doc_id order by Spark's own writer, so a lost task is simply run again.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows of one doc_id are in the order
of their texts, and `fetch_tokens` gives them all; an empty table gives a file set without shards; further
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import mix, shared_folder, text_bytes
from .tokens import ByteLevel, WhiteSpaceFree, encoder, vocabulary

#: The key of a null doc_id.
NO_ID = -(1 << 63)
#: Parts whose ids are summed together.
PART_GROUP = 2048
#: A shard ends with the document that reaches either.
SHARD_DOCS, SHARD_IDS = 4096, 1 << 20
SHARD_SCHEMA = "part int, seq int, lo long, hi long, n_keys int, n_ids long, width int, keys binary, index binary, payload binary"
_HEAD = struct.Struct("<4sII")
_SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u8"), ("length", "<u4")])


def _hashes(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash per key; a key's repeats get hashes of their own."""
    order = np.argsort(keys, kind="stable")
    same = keys[order]
    new = np.append(True, same[1:] != same[:-1]) if len(keys) else np.zeros(0, bool)
    at = np.arange(len(keys))
    nth = np.empty(len(keys), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix(mix(keys.astype(np.int64).view(np.uint64)) + nth * np.uint64(0x9E3779B97F4A7C15))


def _slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ mix(shift.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    """Minimal perfect hash by hash and displace: buckets of about four keys, largest first, each get the first
    displacement that sends all its keys to free slots of exactly len(keys)."""
    h, n = _hashes(keys), len(keys)
    m = max(1, n // 4)
    bucket = (h % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(m + 1))
    shifts, free = np.zeros(m, "<u4"), np.ones(max(n, 1), bool)
    for b in np.argsort(-np.diff(first), kind="stable"):
        own = h[order[first[b] : first[b + 1]]]
        if not len(own):
            break
        step, at = 64, 0
        while True:
            tries = np.arange(at, at + step)
            spots = _slots(own[:, None], tries[None, :], n)
            good = free[spots].all(0)
            if len(own) > 1:
                s = np.sort(spots, 0)
                good &= (s[1:] != s[:-1]).all(0)
            if good.any():
                k = int(np.argmax(good))
                shifts[b], free[spots[:, k]] = tries[k], False
                break
            at, step = at + step, min(4096, step * 4)
    slots = np.zeros(n, _SLOT)
    if n:
        to = _slots(h, shifts[bucket], n)
        slots["fingerprint"][to], slots["offset"][to], slots["length"][to] = h >> np.uint64(32), offsets, lengths
    return _HEAD.pack(b"MPH1", n, m) + shifts.tobytes() + slots.tobytes()


def look_up(index: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """found, offset and length of each key (repeats of a key in keys are its repeats in the shard)."""
    magic, n, m = _HEAD.unpack_from(index)
    if magic != b"MPH1":
        raise ValueError("not an index")
    shifts = np.frombuffer(index, "<u4", m, _HEAD.size)
    slots = np.frombuffer(index, _SLOT, n, _HEAD.size + 4 * m)
    h = _hashes(keys)
    if not n:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    got = slots[_slots(h, shifts[(h % np.uint64(m)).astype(np.int64)], n)]
    return got["fingerprint"] == (h >> np.uint64(32)), got["offset"].astype(np.int64), got["length"].astype(np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", kind: type = WhiteSpaceFree, end_id: int = 2, wide: bool = False, part_bytes: int = 24 << 20) -> None:
    """Encode docs(doc_id, text), end each document with end_id, and write shards to path in ascending doc_id order.

    Ids take two bytes each, or four if wide. part_bytes: text of a task, roughly.
    """
    tokenizer = vocabulary(tokenizer)
    dtype = "<u4" if wide else "<u2"
    names = ["part", "seq", "lo", "hi", "n_keys", "n_ids", "width", "keys", "index", "payload"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def shard(part: int, seq: int, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        if not wide and len(ids) and ids.max() > 0xFFFF:
            raise ValueError("ids of this vocabulary need wide=True")
        row = [part, seq, int(keys[0]), int(keys[-1]), len(keys), len(ids), 4 if wide else 2, keys.tobytes(), build_index(keys, np.cumsum(lengths) - lengths, lengths), ids.astype(dtype).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    def encode(batches):
        enc, part, seq = encoder(kind, tokenizer), TaskContext.get().partitionId(), 0
        keys, lengths, ids = np.zeros(0, "<i8"), np.zeros(0, np.int64), np.zeros(0, "<u4")
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.slice(at, 4096)
                more, n = enc.encode_column(own.column("text"), end_id)
                keys = np.append(keys, own.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                lengths, ids = np.append(lengths, n), np.append(ids, more)
                while len(keys):
                    size = np.cumsum(lengths)
                    docs_ = min(SHARD_DOCS, int(np.searchsorted(size, SHARD_IDS)) + 1)
                    if docs_ > len(keys):
                        break
                    yield shard(part, seq, keys[:docs_], lengths[:docs_], ids[: size[docs_ - 1]])
                    keys, lengths, ids, seq = keys[docs_:], lengths[docs_:], ids[size[docs_ - 1] :], seq + 1
        if len(keys):
            yield shard(part, seq, keys, lengths, ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(8, -(-text_bytes(rows) // part_bytes))
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


def _found(keys: np.ndarray, row: dict, kept: np.ndarray | None = None):
    ok, offset, length = look_up(row["index"], keys)
    if not ok.all() and kept is None:
        raise ValueError("a key of the shard isn't in its index")
    return ok, offset, length


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a file set by its key: doc_id, start (ids before it in the whole set), n_tokens, ids_crc32 (over 4-byte ids).

    A document's ids are found through the shard's index, as look-ups of single keys find them.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # Ids before each shard, on three levels: groups of parts, parts, shards. No window sees more than all groups, a group's parts or a part's shards.
    def before(sums: DataFrame, by: str, *within: str) -> DataFrame:
        return sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    sums = shards.select("part", "seq", F.col("n_ids").alias("n"), (F.col("part") / PART_GROUP).cast("int").alias("group"))
    parts = sums.groupBy("group", "part").agg(F.sum("n").alias("n"))
    groups = before(parts.groupBy("group").agg(F.sum("n").alias("n")), "group")
    bases = before(parts, "part", "group").join(groups.select("group", F.col("before").alias("base")), "group").select("part", (F.col("before") + F.col("base")).alias("base"))
    starts = before(sums, "seq", "part").join(bases, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("first"))

    def decode(batches):
        for b in batches:
            for row in b.to_pylist():
                keys = np.frombuffer(row["keys"], "<i8")
                _, offset, length = _found(keys, row)
                ids = np.frombuffer(row["payload"], "<u4" if row["width"] == 4 else "<u2")
                crc = [zlib.crc32(ids[o : o + n].astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist())]
                key = pa.array(keys, pa.int64(), mask=keys == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["part"], np.int32)), pa.array(np.full(len(keys), row["seq"], np.int32)), key, pa.array(offset), pa.array(length), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(decode, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def fetch_tokens(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id and ids of single documents, for a list of keys: shards are pruned by their key range, then one look-up each."""
    wanted = np.unique(np.array(keys, "<i8"))

    def pick(batches):
        for b in batches:
            for row in b.to_pylist():
                stored = np.sort(np.frombuffer(row["keys"], "<i8"))
                own = wanted[(wanted >= row["lo"]) & (wanted <= row["hi"])]
                own = np.repeat(own, np.searchsorted(stored, own, "right") - np.searchsorted(stored, own, "left"))
                ok, offset, length = _found(own, row, own)
                ids = np.frombuffer(row["payload"], "<u4" if row["width"] == 4 else "<u2")
                hits = [(int(k), ids[o : o + n].astype("<i8").tolist()) for k, o, n, y in zip(own, offset, length, ok) if y]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = F.lit(False)
    for k in wanted.tolist():
        near = near | ((F.col("lo") <= k) & (F.col("hi") >= k))
    return spark.read.schema(SHARD_SCHEMA).parquet(path).where(near).mapInArrow(pick, "doc_id long, ids array<long>")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)


__all__ = ["ByteLevel", "WhiteSpaceFree", "build_index", "fetch_tokens", "look_up", "op9_token_files", "read_tokens", "write_tokens"]
