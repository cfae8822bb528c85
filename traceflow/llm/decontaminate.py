"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `window` consecutive words of an item (a shorter item is one window). Windows are
sets of word shingles; shingles are ordered by rarity, which is told beforehand from the counts of benchmark words over all
documents (a shingle is as rare as its rarest word). Only a window's rarest shingle, its necessary prefix, meets the documents;
the position and length bounds then place the window in the document, and the document's words there are compared with
the window's, all in the stage that scans the documents.

Defined results: null and empty texts have no words, are hit nowhere and never contaminated;
null and wordless items have no window; repeated items are one; repeated rows are reported each, and rows of one doc_id with
different texts are told apart by a hash of the text; null doc_ids are joined like any other;
with an empty benchmark nothing is hit; further columns are ignored here and kept by `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import unused, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str):
    """Words of a text column: A-Z lower-cased, cut at ASCII other than letters and digits."""
    return F.coalesce(F.array_remove(F.split(F.translate(F.col(text), UPPER, LOWER), SEPARATORS), ""), F.array().cast("array<string>"))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Each distinct window once: win (its words, joined), len, w."""
    items = benchmark.select(words("text").alias("w")).where("size(w) > 0").withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = items.select("w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    return starts.select(F.slice("w", F.col("s"), F.col("len")).alias("w"), "len").distinct().select(F.concat_ws(" ", "w").alias("win"), "len", "w")


def _prefixes(docs: DataFrame, windows: DataFrame, shingle: int, block: int) -> DataFrame:
    """win, len, k, off, prefix: for each window the place and the words of its rarest shingle; windows with a word that no document has are left out."""
    wanted = written(windows.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    every = docs.select(F.explode("w").alias("word"))
    few = size.n <= block and size.bytes <= 20 * block  # then words of no item are left out before they are counted
    counts = (every.join(F.broadcast(wanted), "word", "left_semi") if few else every).groupBy("word").agg(F.count("*").alias("n"))
    rarity = counts if few else counts.join(wanted, "word", "left_semi")
    each = windows.select("win", "len", F.posexplode("w").alias("at", "word")).join(rarity, "word")
    ranked = each.groupBy("win", "len").agg(F.array_sort(F.collect_list(F.struct("at", "n", "word"))).alias("e")).where("size(e) = len").withColumn("k", F.least("len", F.lit(shingle)))
    cut = ranked.select("win", "len", "k", "e", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off")).withColumn("sh", F.slice("e", F.col("off") + 1, F.col("k")))
    cut = cut.select("win", "len", "k", F.struct(F.array_min("sh.n").alias("n"), F.aggregate("sh.n", F.lit(0.0), lambda t, n: t + F.log(n.cast("double"))).alias("all"), "off", F.col("sh.word").alias("w")).alias("p"))
    return cut.groupBy("win", "len", "k").agg(F.min("p").alias("p")).select("win", "len", "k", "p.off", F.col("p.w").alias("prefix"))


def _found(docs: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """key, n_words, start, len, wid of each occurrence of a window: candidates by prefix, bounds, then the window's words.

    Generate, the shingle's hash and the broadcast join form one generated stage; the words travel as a reference.
    """

    def code(size, word):
        """The hash of a shingle's words, for each possible size."""
        out = F.lit(None).cast("long")
        for k in sizes:
            out = F.when(size == k, F.xxhash64(*[word(i) for i in range(k)])).otherwise(out)
        return out

    wanted = prefixes.select("win", "len", "k", "off", code(F.col("k"), lambda i: F.get("prefix", F.lit(i))).alias("code"))
    each = docs.select("key", "n_words", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("pos")).where("n_words > 0")
    each = each.select("key", "n_words", "w", "pos", F.explode(F.array(*map(F.lit, sizes))).alias("dk")) if len(sizes) > 1 else each.withColumn("dk", F.lit(sizes[0]))
    each = each.withColumn("dcode", F.when(F.col("pos") + F.col("dk") <= F.col("n_words"), code(F.col("dk"), lambda i: F.get("w", F.col("pos") + i))))
    start = F.col("pos") - F.col("off")
    hit = each.join(F.broadcast(wanted), (F.col("dcode") == F.col("code")) & (F.col("dk") == F.col("k")) & (start >= 0) & (start + F.col("len") <= F.col("n_words")))
    return hit.withColumn("start", start).where(F.concat_ws(" ", F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len"))) == F.col("win")).select("key", "n_words", "start", "len", F.xxhash64("win", "len").alias("wid"))


def _row_key(docs: DataFrame):
    """What tells documents apart: an id that is never null, and the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64("text").alias("text"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated.

    docs(doc_id, text), benchmark(item_id, text). shingle: words of a prefix. block: windows whose prefixes are broadcast at
    once, of at most block * 200 bytes together; a larger benchmark is joined in several such blocks, so a broadcast never exceeds that.
    """
    return _contamination(docs, benchmark, window, shingle, block).drop("key")


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block: int) -> DataFrame:
    """find_contamination's rows, with their keys."""
    key = _row_key(docs)
    cut = docs.select(key.alias("key"), words("text").alias("w")).withColumn("n_words", F.size("w").cast("long"))
    windows = written(_windows(benchmark, window), "item_windows")
    prefixes = written(_prefixes(cut, windows, shingle, block), "prefixes")
    size = prefixes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("win")), F.lit(0)).alias("chars"), F.collect_set("k").alias("ks")).first()
    blocks = max(1, -(-size.n // block), -(-size.chars // (200 * block)))
    ok = None
    for i in range(blocks if size.n else 0):
        got = _found(cut, prefixes if blocks == 1 else prefixes.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == i), sorted(size.ks))
        ok = got if ok is None else ok.unionByName(got)
    if ok is None:
        ok = cut.limit(0).select("key", "n_words", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("wid"))
    ok = written(ok.distinct(), "windows")  # rows that repeat an id and a text have the same occurrences

    hit = ok.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    items = ok.select("key", "wid").distinct().join(_item_windows(benchmark, window), "wid").select("key", "item_id").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item_id"))), 256).alias("items_sha256"))
    out = cut.select("key", "n_words").join(hit.join(items, "key"), "key", "left")
    return out.select("key", F.when(~F.col("key.none"), F.col("key.id")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """wid, item_id (as text) of each window of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where("size(w) > 0").withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = items.select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    return starts.select("item_id", F.xxhash64(F.concat_ws(" ", F.slice("w", F.col("s"), F.col("len"))), "len").alias("wid")).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0, window: int = 10, shingle: int = 5, block: int = 500_000) -> DataFrame:
    """docs without those of which more than least_share of the words are hit. Rows of one id, or of none, are judged by their own texts."""
    key = unused(docs.columns, "__key")
    bad = _contamination(docs, benchmark, window, shingle, block).where((F.col("n_hit") > 0) & (F.col("n_hit") > F.lit(least_share) * F.col("n_words"))).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, _row_key(docs)).join(bad, key, "left_anti").select(*docs.columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS txt
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS txt
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.s, d.n, w.item_id FROM dwin d JOIN win w ON d.n = w.n AND d.txt = w.txt),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
