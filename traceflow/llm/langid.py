"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Weights are sparse: follow-the-regularised-leader with an elastic-net penalty. A temperature fitted on held-back
rows calibrates the probabilities. Document frequencies are counted over all eligible documents; weights are fitted on a
bounded sample of them (per_lang rows a language).

Defined results: null texts and texts without a letter are `und` with score 0; rows of null language are never learned
from; equal probabilities go to the language first in the alphabet; without an eligible row every text is `und`;
repeated rows are predicted each; further columns pass through `identify` unless they bear an output's name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import constants, unused
from .toxicity import held_out

BUCKETS = 1 << 14
LETTER = re.compile(r"[^\W\d_]")
_M = constants(6, 31)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's character 1-, 2- and 3-grams, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [c * _M[0]]
    if len(c) > 1:
        found.append(c[:-1] * _M[1] + c[1:] * _M[2])
    if len(c) > 2:
        found.append(c[:-2] * _M[3] + c[1:-1] * _M[4] + c[2:] * _M[5])
    n = np.bincount((np.concatenate(found) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass(frozen=True)
class LanguageModel:
    languages: list
    idf: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        x = np.log1p(n) * self.idf[at]
        return at, x / max(float(np.sqrt((x * x).sum())), 1e-9)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0
        at, x = self.vector(text)
        p = softmax((self.weights[:, at] @ x + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal, one example at a time."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def leader(at):
        s = z[:, at]
        return np.where(np.abs(s) <= l1, 0.0, -(s - np.sign(s) * l1) / ((beta + np.sqrt(n[:, at])) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = leader(at)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = leader(np.arange(BUCKETS + 1))
    return w[:, :-1], w[:, -1]


def _df_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for t in b.column("text"):
            at, _ = counts(t.as_py() or "")
            df[at] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "df"])


def _sample_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [counts(t.as_py() or "") for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([a.astype("<u2").tobytes() for a, _ in got], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())], names=["lang", "at", "n"])


def fit_languages(docs: DataFrame, per_lang: int = 800, max_rows: int = 40_000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> LanguageModel:
    """Learn from docs(doc_id, text, lang). per_lang bounds the rows of a language that the weights are fitted on
    (chosen by a hash of doc_id and text), and max_rows those of all languages together; document frequencies cover all rows."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0))
    df = np.zeros(BUCKETS)
    rows = 0
    for r in known.select("text").mapInArrow(_df_map, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # BUCKETS + 1 rows
        if r.bucket < 0:
            rows = r.df
        else:
            df[r.bucket] = r.df
    idf = np.log((rows + 1) / (df + 1)) + 1
    per_lang = max(1, min(per_lang, max_rows // len(languages)))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / sizes[lang]))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30) < share
    table = known.where(drawn).mapInArrow(_sample_map, "lang string, at binary, n binary").toArrow().to_pylist()  # about per_lang rows a language
    base = LanguageModel(languages, idf, np.zeros((len(languages), BUCKETS)), np.zeros(len(languages)))
    examples = []
    for r in sorted(table, key=lambda r: (r["lang"], r["at"], r["n"])):
        at, n = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")
        x = np.log1p(n) * idf[at]
        if len(at):
            examples.append((at, x / np.sqrt((x * x).sum()), languages.index(r["lang"])))
    back = examples[::5] if len(examples) >= 50 else examples
    w, b = ftrl([e for i, e in enumerate(examples) if i % 5 or len(examples) < 50], len(languages), epochs, alpha, beta, l1, l2)
    logits = np.array([w[:, at] @ x + b for at, x, _ in back])
    y = np.array([e[2] for e in back])
    loss = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)} if len(y) else {1.0: 0.0}
    return LanguageModel(languages, base.idf, w.astype(np.float32), b, float(min(loss, key=loss.get)))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in keep, or all) with lang_pred and lang_score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden := unused(keep, "__text")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["lang_pred string", "lang_score double"])

    def predict(batches):
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(hidden)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "lang_score"])

    return source.mapInArrow(predict, schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
