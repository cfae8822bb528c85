"""Neighbours, periodic runs and token alignment against brute force on small tables with the awkward cases:
nulls, empty and long texts, ties, repeated rows, further columns with clashing names, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceflow.llm import align, neighbours, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, slice string, w string, pairs string, n string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "s", "w", "p", "n") for i, t in texts], SCHEMA).repartition(3)


def periodic(words, least):
    """All runs of at least `least` words, by comparing every distance."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def loop_texts(seed=5):
    rng = random.Random(seed)
    out = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a b " * 6, "x y " * 12, "abc " * 5 + "abd " * 5]
    for _ in range(150):
        w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(1, 70))]
        if rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randint(1, 9)
            w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    out += [" ".join(str(rng.randrange(50)) for _ in range(4000)), "é " * 5000]
    return [*enumerate(out), (3, "one"), (None, "z " * 20)]


@pytest.mark.parametrize("slice_words,look", [(runs.SLICE_WORDS, runs.LOOK), (50, 7)])
def test_find_runs(monkeypatch, slice_words, look):
    monkeypatch.setattr(runs, "LOOK", look)
    cut = [WORD.findall(t or "") for _, t in loop_texts() if len(t or "") < 5000]
    for i in range(0, len(cut), 20 if slice_words > 50 else 1):
        part = cut[i : i + 20]
        offsets = np.append(0, np.cumsum([len(w) for w in part])).astype(np.int64)
        row, start, length, period = runs.find_runs(pa.array([x for w in part for x in w], pa.string()), offsets, 4)
        for j, w in enumerate(part):
            got = [(int(a), int(b), int(c)) for r, a, b, c in zip(row, start, length, period) if r == j]
            assert sorted(got) == periodic(w, 4), w


def test_runs_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "SLICE_WORDS", 300)
    texts = [(i, t) for i, t in loop_texts()] + [(i, " ".join(f"w{i}x{k}" for k in range(i % 90))) for i in range(1000, 1120)]
    sf = str(tmp_path)
    table(spark, texts).write.parquet(f"{sf}/documents.parquet")
    got = Counter(runs.op12_runs(spark, sf).collect())
    want, seen = Counter(), 0
    for i, t in texts:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
            seen += 1
        found = periodic(w, 12) if len(set(w)) > 1 or len(w) < 100 else [(0, len(w), 1)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in found), default=None)
        four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want and seen > 5
    assert runs.collapse_runs(table(spark, [])).count() == 0


def test_runs_interface(spark):
    got = {r.doc_id: r for r in runs.collapse_runs(table(spark, [(1, "so " + "ha hi " * 9 + "end"), (2, None)])).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 18, 2)] and got[1].text == "so ha hi end" and got[1].n_words == 20
    assert got[2].runs == [] and got[2].text == ""


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pair_texts(seed=6):
    rng = random.Random(seed)
    vocab = ["naïve", "the", "straße", "running", "漢字", "🙂🙂", "x=1;", "don't", "</s>", "<|endoftext|>", "<0x41>", "1234567", "ﬁ", "½"]
    texts = [None, "", " ", "a", "Hello  world\n\tx", " lead", "trail ", "two▁parts", "x" * 3000, "  " * 40 + "\n\n", "\u0000\u0001", "é ́"]
    texts += [rng.choice(["", " "]) + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts.append(" ".join(rng.choice(vocab) for _ in range(5000)))
    return [*enumerate(texts), (3, "a"), (None, "the the")]


def test_align(spark, tmp_path, monkeypatch):
    a_tok, b_tok, letter = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_letters()
    a_tok.encode_special_tokens = True
    monkeypatch.setattr(align, "BLOCK", 100)

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    rows, count = [], Counter()
    for i, t in pair_texts():
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ab = [bytes(letter[c] for c in a_tok.id_to_token(x)) for x in a]
        bb = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(ab) != f" {t}".encode() or b"".join(bb) != f" {t}".encode():
            a, b, ab, bb = [], [], [], []
        ea, eb = ends(ab), ends(bb)
        links, j = [], 0
        for x, (e, z) in enumerate(zip(ea, ab)):
            while j < len(eb) and eb[j] <= e - len(z):
                j += 1
            y = j
            while y < len(eb) and eb[y] - len(bb[y]) < e:
                links.append((a[x], b[y]))
                y += 1
        groups, last, shared = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            ga, gb = ([str(v) for v, e in zip(ids, es) if last < e <= c] for ids, es in ((a, ea), (b, eb)))
            groups.append(",".join(ga) + "|" + ",".join(gb))
            shared += len(ga) * len(gb)
            last = c
        count.update(links)
        rows.append((i, len(a), len(b), len(groups), links, shared, ";".join(groups)))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = Counter((i, na, nb, ng, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, ls, _, g in rows)
    sf = str(tmp_path)
    table(spark, pair_texts()).write.parquet(f"{sf}/documents.parquet")
    assert Counter(align.op13_align(spark, sf).collect()) == want
    whole = Counter((r.doc_id, r.n_shared, r.groups) for r in align.align(table(spark, pair_texts())).collect())
    assert whole == Counter((r[0], r[5], r[6]) for r in rows)
    assert align.align(table(spark, [])).count() == 0


def test_sparse_products(monkeypatch):
    rng = np.random.default_rng(4)

    def dense(m):
        out = np.zeros((m.rows, m.columns), np.int64)
        out[m.row_of(), m.indices] = m.values
        return out

    def sparse(x):
        r, c = np.nonzero(x)
        return align.CSR(np.searchsorted(r, np.arange(len(x) + 1)), c.astype(np.int32), x[r, c], x.shape[1])

    monkeypatch.setattr(align, "BLOCK", 3)
    for _ in range(50):
        n, k, m = rng.integers(1, 9, 3)
        a, b = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))
        got = sparse(a) @ sparse(b)
        assert (dense(got) == a @ b).all() and (dense(sparse(a).T) == a.T).all() and (sparse(a).dot(np.arange(k)) == a @ np.arange(k)).all()
        assert all((np.diff(got.indices[x:z]) > 0).all() for x, z in zip(got.indptr, got.indptr[1:]))
    # links of tokens of one group hold the overlaps
    size = [np.array([2, 1, 3, 2]), np.array([1, 2, 1, 1, 3])]
    one = align.Aligned(np.arange(4), size[0], np.zeros(4, int), np.arange(5), size[1], np.zeros(5, int))
    shared = dense(one.shared_links())
    assert (shared >= (dense(one.links) > 0)).all() and shared.sum() == one.shared().sum()
    assert dense(one.links).sum() == 8


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 12))
    x = (centre[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 12))).astype(np.float32).astype(float)
    x[500:900] = x[500]  # copies
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)]
    rows += [(3000, None, "a", 1), (3100, [0.0] * 12, "a", 1), (3200, [float("nan")] * 12, "a", 1), (3300, [None] * 12, "a", 1), (3400, [float("inf")] + [1.0] * 11, "a", 1), (None, [1.0] * 12, "a", 1), (3500, [], "a", 1)]
    rows += [(3600, [1.0, 2.0], "a", 1), (3601, [1.0, 3.0], "a", 1), (3602, [1.0, 2.5], "a", 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string, shard int").repartition(3)
    for shard_rows, block in ((700, 9), (10_000, 10_000)):
        got = neighbours.nearest(t, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, query_block=block).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(by) == {*range(0, 3000, 100), 3600}
        assert [(r, v) for r, v, _ in by[3600]] == [(1, 3602), (2, 3601)]
        hit = 0
        for q in range(0, 3000, 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            assert [r for r, _, _ in by[q]] == list(range(1, 11))
            assert all(abs(s - d[v]) < 1e-12 for _, v, s in by[q]) and [(s, v) for _, v, s in by[q]] == sorted((s, v) for _, v, s in by[q])
            hit += len({v for _, v, _ in by[q]} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
        assert hit >= 0.9 * 300
        assert [v for _, v, _ in by[600]] == [*range(500, 510)]  # ties by id
    assert neighbours.nearest(t.limit(0), F.col("vec_id") % 100 == 0).count() == 0
