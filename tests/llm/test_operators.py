"""The operators of traceflow.llm against brute force on small tables that hold the awkward cases:
nulls, empty and long texts, copies, near copies, repeated rows, hot passages, further columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceflow.llm import decontaminate, jaccard, langid, lines, packing, repeats, substring, suffix, tokenfile, topk, toxicity
from traceflow.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, line string"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["ka", "lo", "mi", "né", "tu", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, base, line = say(30), say(120), "buy now for only 12 euros today"
    texts = [None, "", " ", "\n\n", "one", "one two three", base, base, base]
    texts += [say(rng.randint(1, 80)) for _ in range(n)]
    texts += [say(10) + " " + passage + "  " + say(12) for _ in range(6)]
    for i in range(12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [say(9) + "\n" + line.replace("12", str(i)) + "\n" + say(7) for i in range(8)]
    texts += [say(4000), "x" * 700, "x" * 700 + say(30)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 9 == 0 else ["en", "fr"][i % 2], "s", None, "clash", "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot,most", [(repeats.HOT, substring.MOST_CLASSES), (repeats.HOT, 2), (0, 2), (2, 64)])
def test_substring(docs, empty, monkeypatch, hot, most):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(substring, "MOST_CLASSES", most)
    got = {r.doc_id: r for r in substring.remove_repeated_words(docs).collect()}
    seen = set()
    for i, t in corpus():
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert substring.remove_repeated_words(empty).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT, 0, 2])
def test_suffix(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r.doc_id: r for r in suffix.remove_repeated_bytes(docs).collect()}
    seen = set()
    for i, t in corpus():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if b[s : s + 50] in seen:
                gone[s : s + 50] = True
        seen |= {b[s : s + 50] for s in range(len(b) - 49)}
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()), i
        assert r.n_spans == int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    assert suffix.remove_repeated_bytes(empty).count() == 0


def test_block_sort():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 99, 2000).astype(np.uint8)
    text = np.concatenate([base, base[300:900], np.full(300, 97, np.uint8), base[:77]])
    places = np.arange(len(text) - 50)
    p, group = suffix.equal_stretches(text, places, 50)
    raw = text.tobytes()
    assert sorted(p) == list(places)
    assert all(raw[a : a + 50] <= raw[b : b + 50] for a, b in zip(p, p[1:]))
    assert all((g == h) == (raw[a : a + 50] == raw[b : b + 50]) for a, b, g, h in zip(p, p[1:], group, group[1:]))


def near_copies(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("hot,block", [(64, 384), (3, 5)])
def test_jaccard(docs, empty, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, 4, 85).collect()}
    assert got == near_copies(corpus(), 4, 85)
    assert jaccard.near_duplicates(empty, 4, 85).count() == 0


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in near_copies(corpus(), 5, 80).items() if c == i}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(100, 50), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 50: 50, 100: 50}


def test_decontaminate(spark, docs, empty):
    w = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: w.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = dict(corpus())
    items = [(1, " ".join(texts[20].split()[:14]).upper()), (2, "One, two!"), (3, None), (4, ""), (5, " ".join(texts[6].split()[40:60])), (5, "one two three"), (11, texts[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {}
    for i, t in items:
        x = words(t)
        for s in range(max(1, len(x) - 9) if x else 0):
            wins.setdefault(tuple(x[s : s + 10]), set()).add(str(i))
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench).collect()}
    for i, t in texts.items():
        x, hit, found = words(t), set(), set()
        for k, ids in wins.items():
            for s in range(len(x) - len(k) + 1):
                if tuple(x[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    found |= ids
        want = (len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, i
    blocks = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, block=7).collect()}
    assert blocks == got
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_null_id(spark):
    item = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(None, f"so {item} end"), (0, "nothing of it here"), (1, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.find_contamination(df, bench).collect()}
    assert got == {None: (13, 11, 1, True), 0: (4, 0, 0, False), 1: (11, 11, 1, True)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()] == [0]


def test_decontaminate_repeated_ids(spark):
    """Rows of one doc_id and one number of words keep their own hits, also where a row is repeated."""
    item = "one two three four five six seven eight nine ten"
    other = "ten nine eight seven six five four three two one"
    df = spark.createDataFrame([(3, item), (3, other), (3, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    assert sorted(r.n_hit for r in decontaminate.find_contamination(df, bench).collect()) == [0, 10, 10]


def test_packing(docs, empty):
    rows = packing.pack(docs, window=64, with_ids=True).collect()
    enc = packing.ByteLevel("byte_bpe_50k.json")
    ids = {i: np.append(np.frombuffer(enc.encode(t or ""), "<u4"), 1) for i, t in corpus()}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == piece.tolist() and r.ids_crc32 == zlib.crc32(piece.astype("<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id][r.start : r.start + r.length] += 1
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert all((x == 1).all() for x in seen.values())
    assert all(n == 64 or n & (n - 1) == 0 for n in at.values())
    assert packing.pack(empty).count() == 0


def test_packing_takes_all_neighbours():
    """A window takes every document that shares a term with its seed, in score order, and not only some, before others."""
    n = 160
    rows, terms = np.tile(np.arange(n), 2), np.append(np.arange(n) % 2, 2 + np.arange(n))
    index = packing.BM25(rows, terms.astype(np.uint64), n)
    assert packing.retrieval_order(index, np.full(n, 10), 10_000) == [*range(0, n, 2), *range(1, n, 2)]
    score = np.array([0.5, 2, 0, 1, 2, 0.25] * 20)
    assert list(packing.ranked(score)) == sorted(np.flatnonzero(score).tolist(), key=lambda i: (-score[i], i))


def test_packing_scores_by_all_terms():
    """Document 0 shares one rare term each with 20 documents, and 40 less rare ones with the last."""
    pairs = [(d, t) for t in range(20) for d in (0, 1 + t)] + [(d, 100 + t) for t in range(40) for d in (0, 50, 51 + t % 3)]
    rows, terms = (np.array(x) for x in zip(*pairs))
    index = packing.BM25(rows, terms.astype(np.uint64), 60)
    want = np.zeros(60)
    for t in index.terms_of[index.row_first[0] : index.row_first[1]]:
        want[index.rows[index.first[t] : index.first[t + 1]]] += index.weight[index.first[t] : index.first[t + 1]]
    assert np.allclose(index.scores(0), want)
    assert packing.retrieval_order(index, np.full(60, 10), 10_000)[1] == 50


def test_packing_index_of_rows_in_any_order():
    """The postings are those of sorted rows, whatever order they come in, and a seed's weightiest terms are asked where only some are."""
    rng = np.random.default_rng(4)
    rows, terms = rng.integers(0, 40, 3000), rng.integers(0, packing.TERMS, 90)[rng.integers(0, 90, 3000)]
    key, tf = np.unique(rows * packing.TERMS + terms, return_counts=True)
    whole = packing.BM25(rows, terms, 40)
    mixed = rng.permutation(len(key))
    for index in (packing.BM25(key // packing.TERMS, key % packing.TERMS, 40, tf), packing.BM25(key[mixed] // packing.TERMS, key[mixed] % packing.TERMS, 40, tf[mixed])):
        for name in ("first", "rows", "weight", "terms_of", "row_first"):
            assert np.array_equal(getattr(index, name), getattr(whole, name)), name
    for seed in range(40):
        own = whole.terms_of[whole.row_first[seed] : whole.row_first[seed + 1]]
        weight = np.array([whole.weight[whole.first[t] : whole.first[t + 1]][whole.rows[whole.first[t] : whole.first[t + 1]] == seed][0] for t in own])
        want = np.zeros(40)
        for t in own[np.argsort(-weight, kind="stable")[:3]]:
            want[whole.rows[whole.first[t] : whole.first[t + 1]]] += whole.weight[whole.first[t] : whole.first[t + 1]]
        assert np.allclose(whole.scores(seed, 3), want)


def test_token_files(spark, docs, empty, tmp_path):
    tokenfile.write_tokens(docs, f"{tmp_path}/a")
    enc = tokenfile.WhiteSpaceFree("word_bpe_49k.json")
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, f"{tmp_path}/a").collect()}
    start, every = 0, {}
    for i, t in corpus():
        every[i] = np.append(np.frombuffer(enc.encode(t or ""), "<u4"), 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(every[i]), zlib.crc32(every[i].astype("<u4").tobytes()))
        start += len(every[i])
    few = {r.doc_id: r.ids for r in tokenfile.fetch_tokens(spark, f"{tmp_path}/a", [5, 40, 99_999]).collect()}
    assert few == {i: every[i].tolist() for i in (5, 40)}
    tokenfile.write_tokens(empty, f"{tmp_path}/b")
    assert tokenfile.read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_index_is_minimal_and_perfect():
    keys = np.array(random.Random(2).sample(range(-(10**12), 10**12), 3000), np.int64)
    n = np.arange(3000)
    index = tokenfile.build_index(keys, n * 7, n)
    ok, offset, length = tokenfile.look_up(index, keys)
    assert ok.all() and (offset == n * 7).all() and (length == n).all()
    assert tokenfile.look_up(index, keys + 10**13)[0].sum() < 5


@pytest.mark.parametrize("shard_rows,block", [(10_000, 2048), (40, 7)])
def test_topk(spark, shard_rows, block, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 16)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 6)), 2)
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (220, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=shard_rows, query_block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    v = np.floor(64 * x).astype(int)
    for q in range(0, 150, 20):
        best = sorted((-int(v[q] @ v[j]), j) for j in range(150) if j != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(j, -s) for s, j in best]
    assert set(got) == set(range(0, 150, 20))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_lines(docs, empty):
    got = {r.doc_id: r for r in lines.drop_recurring_lines(docs).select("doc_id", "text", "leaf", "line").collect()}
    texts = dict(corpus())
    ad = [i for i, t in texts.items() if t and "buy now" in t]
    assert "buy now" in got[ad[0]].text
    for i in ad[1:]:
        assert got[i].text.split("\n") == [x for x in texts[i].split("\n") if "buy now" not in x]
    assert got[0].text is None and got[1].text == "" and all(r.leaf == "clash" for r in got.values())
    base = texts[6]
    assert got[6].text == base  # the first of a group of copies keeps its text
    assert lines.drop_recurring_lines(empty).count() == 0


def test_template_generalises():
    blob = lambda s: lines.parse(s, 2)[4]
    same = ["user bob has logged in", "user eve has logged in", "disk is full at last now"]
    assert lines.cluster([(i, blob(s)) for i, s in enumerate(same)], 0.6) == [0, 0, 2]


@pytest.mark.parametrize("size", [1000, 7])
def test_large_leaves(spark, monkeypatch, size):
    """Every variant of a template goes from all but the first document, also where a leaf is too large for one task."""
    monkeypatch.setattr(lines, "LEAF_LINES", size)
    n = 1500 if size == 1000 else 90
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(9))
    rows = []
    for i in range(n):
        other = " ".join(["report", "for", "customer"] + [name() for _ in range(4)])  # in the same leaf, and like nothing
        t = f"report for customer {name()} at {name()} ready\n{other}"
        rows.append((i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(lines.drop_recurring_lines(df).select("doc_id", "text").collect())
    assert got == {i: t if i == 0 else t.split("\n")[1] for i, t in rows}


def plain_templates(rows, similarity=0.6, least=5):
    """The sets of lines that share a template in at least `least` documents, by the definition: rows are (doc_id, line)."""
    docs = {}
    for d, x in set(rows):
        docs.setdefault(x, set()).add(d)
    hashed = {x: lines.parse(x, 1) for x in docs}
    token = {x: np.frombuffer(h[4], np.uint32).tolist() for x, h in hashed.items()}
    out = set()

    def counts(group, p):
        c = Counter()
        for x in group:
            c[token[x][p]] += len(docs[x])
        return c

    def level(group):
        if sum(len(docs[x]) for x in group) < least:
            return
        n = len(token[group[0]])
        usual = [min(c, key=lambda t: (-c[t], t)) for c in (counts(group, p) for p in range(n))]
        centre = min(group, key=lambda x: (-sum(a == b for a, b in zip(token[x], usual)), -len(docs[x]), hashed[x][1]))
        near = [x for x in group if sum(a == b for a, b in zip(token[x], token[centre])) >= similarity * n]
        if len(set().union(*(docs[x] for x in near))) >= least:
            out.add(frozenset(near))
        rest = [x for x in group if x not in near]
        if rest:
            total = sum(len(docs[x]) for x in rest)
            top = {p: max(counts(rest, p).values()) for p in range(n)}
            by = sorted(sorted((p for p in top if top[p] < total), key=lambda p: (-top[p], p))[: max(1, n // 16)])
            kids = {}
            for x in rest:
                kids.setdefault(tuple(token[x][p] for p in by), []).append(x)
            for k in kids.values():
                level(k)

    leaves = {}
    for x in docs:
        leaves.setdefault(hashed[x][0], []).append(x)
    for group in leaves.values():
        level(group)
    return out


@pytest.mark.parametrize("size", [1000, 60, 7])
def test_templates_by_definition(spark, monkeypatch, size):
    """Templates are those of a plain form, with ties and repeated lines, and don't depend on where a leaf is cut for tasks."""
    rng = random.Random(17)
    monkeypatch.setattr(lines, "LEAF_LINES", size)
    rows, word = [], lambda k: rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) + "x"
    for base in (["log", "in", "of"] + [word(26) for _ in range(7)], ["log", "in", "of"] + [word(26) for _ in range(7)], ["one", "more", "line", "of", "six", "words"]):
        for i in range(150):
            rows.append((rng.randrange(90), " ".join(w if k < 3 or rng.random() > 0.35 else word(26) for k, w in enumerate(base))))
    rows += [(rng.randrange(90), " ".join(["log", "in", "of"] + [word(4) for _ in range(7)])) for _ in range(200)]
    rows += [(rng.randrange(90), " ".join(["long"] * 5 + [word(3) for _ in range(35)])) for _ in range(90)]
    texts = {}
    for d, x in rows:
        texts.setdefault(d, []).append(x)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string").repartition(3)
    got = {}
    for r in lines.find_templates(df, min_words=1)[1].collect():
        got.setdefault(r.template, set()).add(r.line)
    want = {frozenset(lines.parse(x, 1)[1] for x in g) for g in plain_templates(rows)}
    assert set(map(frozenset, got.values())) == want and len(want) > 5


def test_jobs_do_not_grow_with_a_leaf(spark, monkeypatch):
    """A leaf of unlike lines takes as many steps as one ten times as large."""
    monkeypatch.setattr(lines, "LEAF_LINES", 7)
    rng, steps, write = random.Random(5), [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name="stage": steps.append(name) or write(df, name))
    name = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(9))
    count = []
    for n in (60, 600):
        steps.clear()
        assert lines.drop_recurring_lines(spark.createDataFrame([(i, "as it was " + " ".join(name() for _ in range(5))) for i in range(n)], "doc_id long, text string")).count() == n
        count.append(len(steps))
    assert count[0] == count[1]


def test_lines_count_documents(spark):
    """A template's n_docs counts documents: not its lines in one, and not rows that repeat a doc_id."""
    log = lambda i, k: "\n".join(f"now logged in user {'abcdefghijklmnopqrstuvwxyz'[4 * i + j]}x again" for j in range(k))
    rows = [(0, log(0, 4)), (1, log(1, 4)), (2, "stock is up again"), (2, "stock is up again"), *[(2, "stock is up again")] * 3, (3, "stock is up again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(lines.drop_recurring_lines(df).select("doc_id", "text").collect()) == sorted(rows)
    five = spark.createDataFrame([(i, log(i, 2)) for i in range(5)], "doc_id long, text string")
    assert {r.n_docs for r in lines.find_templates(five)[1].collect()} == {5}
    assert dict(lines.drop_recurring_lines(five).select("doc_id", "text").collect()) == {i: log(0, 2) if i == 0 else "" for i in range(5)}


def test_segments():
    rng = random.Random(8)
    for _ in range(200):
        s = [rng.choice([-3, -1, -0.5, 1, 2]) for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(s)

        def recurse(a, b):
            best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [] if best[0] <= 0 else recurse(a, best[2]) + [(best[2], best[3])] + recurse(best[3], b)

        assert sum(x for *_, x in got) == pytest.approx(sum(sum(s[i:j]) for i, j in recurse(0, len(s))))


def test_toxicity(spark, empty):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for k in (10, 12, 15):
                w[k] = rng.choice(["vileone", "viletwo", "vilethree"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, lab.where(~toxicity.held_out("doc_id", 3, 1)))
    got = toxicity.score_toxicity(docs.withColumn("toxicity_score", F.lit("x")), model).collect()
    for r in got:
        assert (r.toxicity_score >= 0.7) == (r.doc_id < 600 and r.doc_id % 5 == 0)
        assert not r.toxicity_passages or r.toxicity_passages[0].start <= 15
    none = toxicity.fit_toxicity(docs, lab.limit(0))
    assert toxicity.score_toxicity(docs, none).where("toxicity_score > 0").count() == 0
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_language(spark, empty):
    rng = random.Random(10)
    kinds = {"aa": "the and of ing ion".split(), "bb": "der die und ung ich".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i in range(200) for k in ["aa" if i % 2 else "bb"]]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].lang_score <= 1 for i, _, k in rows)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert langid.identify(docs, langid.fit_languages(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_clashing_names(spark, docs):
    """Columns named like the operators' own helpers pass through."""
    names = ("__id", "__drop", "__text", "__bad")
    own = docs.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    model = toxicity.ToxicityModel({})
    languages = langid.fit_languages(docs.limit(0))
    bench = spark.createDataFrame([(1, corpus()[20][1])], "item_id long, text string")
    for got in (jaccard.one_of_each(own), lines.drop_recurring_lines(own), decontaminate.drop_contaminated(own, bench), toxicity.score_toxicity(own, model), langid.identify(own, languages)):
        assert {tuple(r) for r in got.select(*names).collect()} == {names}


def test_long_lines_share_a_template(spark):
    """A line of 65 or 200 tokens whose variable place is beyond its leading tokens is boilerplate as a short one is."""
    for n in (64, 65, 200):
        text = lambda i: " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" if k != n // 2 else "name" + chr(97 + i) for k in range(n))  # noqa: E731, B023
        rows = [(i, text(i)) for i in range(20)]
        got = dict(lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == {i: t if i == 0 else "" for i, t in rows}


def test_ftrl_against_a_plain_form():
    """Each weight by the closed form of FTRL-proximal, one coordinate at a time."""
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(30, 4, replace=False)), rng.random(4), int(rng.integers(3))) for _ in range(20)]
    w, b = langid.ftrl(rows, 3, 2, 0.5, 1.0, 0.01, 0.02)
    z, n = {}, {}

    def weight(k, i):
        zi, ni = z.get((k, i), 0.0), n.get((k, i), 0.0)
        return 0.0 if abs(zi) <= 0.01 else -(zi - np.sign(zi) * 0.01) / ((1.0 + ni**0.5) / 0.5 + 0.02)

    order = np.random.default_rng(0)
    for _ in range(2):
        for r in order.permutation(20):
            at, x, y = rows[r]
            every = [*zip(at.tolist(), x.tolist()), (langid.BUCKETS, 1.0)]
            old = {(k, i): weight(k, i) for k in range(3) for i, _ in every}
            logit = [sum(old[k, i] * v for i, v in every) for k in range(3)]
            p = np.exp(logit) / np.exp(logit).sum()
            for k in range(3):
                for i, v in every:
                    g = (p[k] - (k == y)) * v
                    before = n.get((k, i), 0.0)
                    z[k, i] = z.get((k, i), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / 0.5 * old[k, i]
                    n[k, i] = before + g * g
    assert np.allclose([[weight(k, i) for i in range(langid.BUCKETS)] for k in range(3)], w) and np.allclose([weight(k, langid.BUCKETS) for k in range(3)], b)


def test_extreme_value_law():
    """For steps of +1 (probability p) and -1: lambda = ln(q / p), K = (q - p)^2 / q."""
    lam, k = toxicity.extreme_value_law(np.array([1.0, -1.0]), np.array([0.3, 0.7]), step=1.0, terms=400)
    assert lam == pytest.approx(np.log(0.7 / 0.3), rel=1e-6) and k == pytest.approx(0.4**2 / 0.7, rel=1e-3)


def test_segments_are_the_maximal_ones():
    """Ruzzo and Tompa's definition: the best segment (shortest, then first), then the same to its left and right."""
    rng = random.Random(18)
    for _ in range(300):
        s = [rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 12))]

        def recurse(a, b):
            best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [] if best[0] <= 0 else recurse(a, best[3]) + [best[3:]] + recurse(best[4], b)

        assert [x[:2] for x in toxicity.maximal_segments(s)] == recurse(0, len(s))


def test_topk_large_numbers(spark):
    """Components whose products leave the range of a long: scores end there."""
    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 0.0]), (2, [-1e17, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 64 * 64), (2, -(2**63) + 1)]


def test_packed_terms():
    """Terms and their numbers survive packing, also large ones and documents without terms."""
    tf = [[3, 1, 70_000], [], [1], [300, 2]]
    terms = [[0, 5, packing.TERMS - 1], [], [packing.TERMS - 1], [7, 8]]
    steps = [b"".join(int(x).to_bytes(3, "little") for x in np.diff(t, prepend=0)) for t in terms]
    t, f, n = packing._unpacked(steps, [packing._few_bytes(np.array(x, np.int64)) for x in tf])
    assert t.tolist() == sum(terms, []) and f.tolist() == sum(tf, []) and n.tolist() == [3, 0, 1, 2]
    row = np.repeat(np.arange(4), n)
    first, second = packing._weightiest(np.array([1.0, 4, 4, 0, 2, 3]), t, row, np.array([0, 3, 4]), 4)
    assert first.tolist() == [5, -1, -1, 8] and second.tolist() == [packing.TERMS - 1, -1, -1, 7]


def test_rows_without_an_id(spark):
    """Rows that share an id, or have none, are judged by their own texts."""
    item = " ".join(f"item{i}" for i in range(12))
    schema = "doc_id long, text string, __key string"
    rows = [(None, item, "k"), (None, "a clean text", "k"), (5, item, "k"), (5, "other clean text", "k"), (6, "clean too", "k"), (None, None, "k")]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in spark.createDataFrame(rows, schema).collect() if r.text != item]))

    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words, "more"])
    rows = [(None, " ".join(words)), (9, near), (12, " ".join(words)), (None, "alone and without an id"), (None, "alone and without an id"), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(docs).collect())
    assert got == sorted([("None", 56, "9"), ("9", 57, "9"), ("12", 56, "9"), ("None", 1, "None"), ("None", 1, "None"), ("4", 0, "4"), ("None", 0, "None")])
    kept = sorted((str(r.doc_id), str(r.text)) for r in jaccard.one_of_each(docs).collect())
    assert kept == sorted((str(i), str(t)) for i, t in rows if t not in (" ".join(words),))


def test_packing_of_many_texts_without_terms(spark):
    """A hundred thousand empty texts pass in a moment, each its own seed, in order."""
    n = 100_000
    terms = [np.zeros(0, np.int64)] * n + [np.array([3, 5]), np.array([3, 7])]
    size = np.array([len(t) for t in terms])
    index = packing.BM25.__new__(packing.BM25)
    index.n, index.row_first, index.terms_of = len(terms), np.append(0, np.cumsum(size)), np.concatenate(terms)

    def scores(seed, query_terms=None):
        return np.append(np.zeros(n), [1.0, 1.0])

    index.scores = scores
    order = packing.retrieval_order(index, np.ones(len(terms), np.int64), 2048)
    assert order == list(range(n + 2))
