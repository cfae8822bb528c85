"""The pipeline's stages on a small corpus, each against what brute force keeps of its own input."""

import random
import re

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import near_copies

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    item, line = say(14), "all rights reserved by someone in 2020"
    rows, labels = [], []
    for i in range(300):
        t = say(50)
        if i % 6 == 0:
            w = t.split()
            w[20:20] = ["vileone", "vileone", "vileone"]
            t = " ".join(w)
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, t, "en", "s", len(t)))
    base = say(90)
    for i in range(300, 310):
        w = base.split()
        w[i - 300] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(i, say(30) + "\n" + line.replace("2020", str(i)) + "\n" + say(5), "en", "s", 0) for i in range(310, 320)]
    rows += [(320, say(9) + " " + item.upper() + ". " + say(9), "en", "s", 0), (321, None, None, None, None), (322, "", "en", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "x")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert after == {i: t for i, t in before.items() if i >= 300 or i % 6}
        elif name == "line dedup":
            assert set(after) == set(before)
            for i in before:
                want = before[i] if not 310 < i < 320 else "\n".join(x for x in before[i].split("\n") if "rights" not in x)
                assert after[i] == want, i
        elif name == "near copies":
            assert set(after) == {i for i, (_, c) in near_copies(sorted(before.items()), 5, 80).items() if c == i}
        else:
            text = lambda t: " ".join(W.findall((t or "").lower()))
            wins = [" ".join(item.split()[s : s + 10]) for s in range(5)]
            assert set(after) == {i for i, t in before.items() if not any(f" {x} " in f" {text(t)} " for x in wins)}
            assert 320 not in after
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in before.items()}
    for i, n in size.items():
        parts = sorted((r.start, r.length) for r in pieces if r.doc_id == i)
        assert parts[0][0] == 0 and sum(x for _, x in parts) == n
        assert np.array_equal(np.cumsum([x for _, x in parts])[:-1], [s for s, _ in parts[1:]])
