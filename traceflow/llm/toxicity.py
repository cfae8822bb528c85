"""Toxicity by maximum-scoring segments.

Token scores are log-odds of toxic against clean usage under an informative Dirichlet
prior. A linear-time scan finds every maximal-scoring segment of a text, and an
extreme-value law turns each segment's score into an E-value, from which a text's
calibrated score follows.

Defined results: null and empty texts have no segment and get the score of a text without
one; ties between labels of one document count as toxic; repeated rows are scored each; an
empty label table, or one of a single class, gives a model without tokens whose score is 0
for every text; further columns pass through unless they bear an output's name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import unused, written

WORD = re.compile(r"[^\W\d_]+")
#: Stems of these lengths stand in for words that are too rare to judge.
STEMS = (7, 6, 5, 4)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class ToxicityModel:
    odds: dict = field(repr=False)
    background: float = -0.1
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    offset: float = -math.inf


class _Odds(dict):
    """Score of a word: its own log-odds, or those of its longest known stem, or the background."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.odds, self.background = model.odds, model.background

    def __missing__(self, word: str) -> float:
        got = next((self.odds[f] for f in features(word) if f in self.odds), self.background)
        if len(self) > 200_000:
            self.clear()
        self[word] = got
        return got


def maximal_segments(scores: Iterable[float]) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment [start, end) with its score, by the linear-time scan of Ruzzo and Tompa."""
    total = 0.0
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        cand = (i, i + 1, before, total)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= cand[2]:
                j -= 1
            if j < 0 or kept[j][3] >= cand[3]:
                kept.append(cand)
                break
            cand = (kept[j][0], cand[1], kept[j][2], cand[3])
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high in kept]


def _segments(words: list[str], odds: _Odds) -> list[tuple[int, int, float]]:
    """maximal_segments over the words' scores; texts without a positive word are left quickly."""
    scores = [odds[w] for w in words]
    return maximal_segments(scores) if scores and max(scores) > 0 else []


def _statistic(segments: list[tuple[int, int, float]], n: int, model: ToxicityModel) -> float:
    """ln(1 + t), where t is the sum of -ln E over segments of which less than one is expected by chance (E < 1)."""
    return math.log1p(sum(max(0.0, model.lam * s - math.log(max(model.k * n, 1e-9))) for _, _, s in segments))


def extreme_value_law(scores: np.ndarray, p: np.ndarray, step: float = 0.05, terms: int = 60) -> tuple[float, float]:
    """lambda and K of Karlin and Altschul for segments of independent scores with probabilities p; the mean must be negative.

    lambda solves E[exp(lambda X)] = 1. K follows from the first `terms` sums S_k of scores (rounded to a lattice of that step):
    K = exp(-2 sum_k (P(S_k >= 0) + E[exp(lambda S_k); S_k < 0]) / k) / ((1 - exp(-lambda step)) E[X exp(lambda X)] / step).
    """
    at = np.rint(scores / step).astype(np.int64)
    low, high = int(at.min()), int(at.max())
    one = np.bincount(at - low, p, high - low + 1) / p.sum()
    x = np.arange(low, high + 1)
    if high <= 0 or (one * x).sum() >= 0:
        return 1.0, 1.0
    a, z = 1e-6, 1.0
    while (one * np.exp(z * x)).sum() < 1:
        z *= 2
    for _ in range(80):
        mid = (a + z) / 2
        a, z = (a, mid) if (one * np.exp(mid * x)).sum() > 1 else (mid, z)
    lam = (a + z) / 2
    total, sums = 0.0, one
    for k in range(1, terms + 1):
        s = np.arange(k * low, k * low + len(sums))
        total += (sums[s >= 0].sum() + (sums[s < 0] * np.exp(lam * s[s < 0])).sum()) / k
        if k < terms:
            n = len(sums) + len(one) - 1
            size = 1 << (n - 1).bit_length()
            sums = np.maximum(np.fft.irfft(np.fft.rfft(sums, size) * np.fft.rfft(one, size), size)[:n], 0)
    k_ = math.exp(-2 * total) / (-math.expm1(-lam) * (one * x * np.exp(lam * x)).sum())
    return lam / step, min(1.0, k_)


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        keys = list(counts[0].keys() | counts[1].keys())
        got = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["feature", "n_toxic", "n_clean"])
        for c in counts:
            c.clear()
        return got

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = set(WORD.findall((text or "").lower()))
            counts[toxic].update({f for w in words for f in features(w)})
            counts[toxic][""] += len(words)  # all tokens
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
    yield out()


def _sketched(texts: DataFrame) -> DataFrame:
    """Adds the sketch of a text: the smallest hash of its 5-word runs, or of the whole if it is shorter."""
    w = F.col("__words")  # a column of its own: inside the runs it would be cut anew for each
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    cut = texts.withColumn("__words", F.split("text", " "))
    return cut.withColumn("sketch", F.when(F.size(w) >= 5, F.array_min(runs)).otherwise(F.xxhash64("text"))).drop("__words")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, prior: float = 0.1, least_z: float = 3.0, least_share: float = 0.005, drift: float = -0.1) -> ToxicityModel:
    """Learn from docs(doc_id, text) and labels(doc_id, toxic).

    max_rows bounds the labelled rows used (taken in the order of a hash of doc_id), so the label side of the
    join is small enough to broadcast whatever the size of docs. prior: weight of the Dirichlet prior, as a
    share of the tokens seen. least_z: features below that z-score score nothing, as do toxic-leaning
    features of less than least_share of the toxic texts. drift is added to every score, so that segments end. Of copies and near copies (texts with one smallest
    5-word shingle) one counts, and each feature once a text, so copies don't make a word toxic.
    """
    spark = docs.sparkSession
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    train = _sketched(train).groupBy("sketch").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    train = written(train, "training")  # at most max_rows texts, read by all that follows
    counts = train.mapInArrow(_count_map, "feature string, n_toxic long, n_clean long").groupBy("feature").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")).where("t + c >= 3")
    if (all_ := counts.where("feature = ''").first()) is None or not all_.t or not all_.c:
        return ToxicityModel({})
    nt, nc = float(all_.t), float(all_.c)
    least = max(3, math.ceil(least_share * train.where("toxic = 1").count()))
    a0 = prior * (nt + nc)
    a = F.col("t").cast("double").__add__(F.col("c")) * (a0 / (nt + nc))
    odds = F.log((F.col("t") + a) / (nt + a0 - F.col("t") - a)) - F.log((F.col("c") + a) / (nc + a0 - F.col("c") - a))
    z = F.col("odds") / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    # only significant features come to the driver, of either leaning: at most (tokens of max_rows texts) / 3, in practice far fewer
    found = counts.where("feature != ''").withColumn("odds", odds).where((z <= -least_z) | (z >= least_z) & (F.col("t") >= least)).collect()
    known = {r.feature: r.odds + drift for r in found}
    # Scores of words of clean texts: those of known words as often as they are seen, the drift for the others; one toxic word is added.
    seen = [(r.odds + drift, r.c) for r in found if not r.feature.endswith("~")]
    law = np.array([(drift, max(1.0, nc - sum(c for _, c in seen))), (max((s for s, _ in seen), default=1.0), 1.0), *seen])
    lam, k = extreme_value_law(law[:, 0], law[:, 1])
    model = ToxicityModel(known, drift, lam, k)

    def stat_map(batches):
        odds = _Odds(model)
        for b in batches:
            x = []
            for text in b.column("text").to_pylist():
                words = WORD.findall((text or "").lower())
                x.append(_statistic(_segments(words, odds), len(words), model))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("toxic")], names=["x", "toxic"])

    points = [(r.x, r.toxic) for r in train.mapInArrow(stat_map, "x double, toxic int").collect()]  # max_rows numbers
    slope, offset = _logistic(points)
    return ToxicityModel(known, drift, lam, k, slope, offset)


def _logistic(points: list[tuple[float, int]], steps: int = 100) -> tuple[float, float]:
    """Slope and offset of P(toxic | x) by Newton's method with halved steps, smoothed targets and a weak ridge."""
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    n1 = y.sum()
    y = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    ridge, X, w = np.array([1e-2, 1e-6]), np.stack([x, np.ones_like(x)], 1), np.zeros(2)

    def loss(w):
        z = X @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + (ridge * w * w).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -500, 500)))
        step = np.linalg.solve((X * (p * (1 - p) + 1e-9)[:, None]).T @ X + np.diag(ridge), X.T @ (y - p) - ridge * w)
        size, at = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > at:
            size /= 2
        w = w + size * step
        if abs(size * step).max() < 1e-7:
            break
    return max(float(w[0]), 0.0), float(w[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, passages: bool = True) -> DataFrame:
    """docs (its columns in keep, or all) with toxicity_score and, if asked for, toxicity_passages:
    words [start, end) of each significant passage (E-value below 1) with its score and E-value."""
    outputs = ["toxicity_score"] + ["toxicity_passages"] * passages
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden := unused(keep, "__text")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != hidden] + ["toxicity_score double"] + ["toxicity_passages array<struct<start:int,end:int,score:double,e_value:double>>"] * passages)

    def score_map(batches):
        odds = _Odds(model)
        for b in batches:
            scores, found = [], []
            for t in b.column(hidden).to_pylist():
                words = WORD.findall((t or "").lower())
                segments = _segments(words, odds)
                x = model.slope * _statistic(segments, len(words), model) + model.offset
                scores.append(0.0 if x < -500 else 1 / (1 + math.exp(-x)))
                if passages:
                    e = [(a, z, s, min(1e9, model.k * len(words) * math.exp(-model.lam * s))) for a, z, s in segments]
                    found.append([{"start": a, "end": z, "score": s, "e_value": v} for a, z, s, v in e if v < 1])
            arrays = [b.column(c) for c in keep] + [pa.array(scores, pa.float64())]
            if passages:
                arrays.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=keep + outputs)

    return source.mapInArrow(score_map, schema)


def held_out(doc_id: str, parts: int, which: int):
    """Whether crc32 of the id as text leaves `which` when divided by `parts`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == which


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held_out("doc_id", 3, 1)))
    return score_toxicity(docs, model, keep=["doc_id"], passages=False).select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.7).cast("int").alias("predicted"))
