"""Token ids against the tokenizers library."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from traceflow.llm.tokens import LONG, ByteLevel, WhiteSpaceFree

PARTS = ["the", " ", "  ", "\n", "it's", "we'll", "123", "4", ".", ",", "!?", "Éa", "é", "ß", "Σ", "İ", " ", "\t", "\x1c", "²", "Ⅷ", "漢字", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\U0001f600", "_", "'", "a'sb", "\r\n", " ", "Foo.\nBar"]


@pytest.mark.parametrize("kind,name", [(ByteLevel, "byte_bpe_50k.json"), (WhiteSpaceFree, "word_bpe_49k.json")])
def test_ids(kind, name):
    enc, t = kind(name), Tokenizer.from_file(P.path(name))
    rng = random.Random(5)
    texts = ["", " ", "a", "a ", " a"] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    for x in texts:
        assert np.frombuffer(enc.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("kind,name", [(ByteLevel, "byte_bpe_50k.json"), (WhiteSpaceFree, "word_bpe_49k.json")])
def test_long_runs(kind, name):
    """White space and words of a million characters, alone and between words; columns with nulls."""
    enc, t = kind(name), Tokenizer.from_file(P.path(name))
    texts = ["a" + c * 1_000_000 + " b" for c in (" ", "\t", "\n", "\u3000", "\u00a0 ")] + ["x" * 300_000, "<|endoftext|> hi", "  <|endoftext|>  hi ", None, ""]
    ids, n = enc.encode_column(pa.array(texts), 7)
    for x, a, z in zip(texts, np.cumsum(n) - n, np.cumsum(n)):
        assert ids[a:z].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 7]


def test_white_space_of_every_kind():
    """Every white space alone, twice, mixed, at both ends and between words; runs of null characters, which tiktoken's one special token is made of."""
    enc, t = ByteLevel("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    rng = random.Random(11)
    texts = [f"{b}{a}{m}{a}{m}{e}" for a in white for b in ("", " ", "x", "x ") for m in ("", " ", a, "word", " word", ".\nWord", "'s") for e in ("", " ", "\n")]
    texts += ["".join(rng.choice([*white, " ", " ", " the", " w,", "\nIn", "é", "“x”", "\x1c", "12", "'ll"]) for _ in range(rng.randint(2, 30))) for _ in range(3000)]
    texts += [f"{a}{chr(0) * n}{z}" for a in ("", "a ") for n in (1, LONG - 1, LONG, 2 * LONG) for z in ("", " b")]
    ids, n = enc.encode_column(pa.array(texts))
    for x, a, z in zip(texts, np.cumsum(n) - n, np.cumsum(n)):
        assert ids[a:z].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_look_ahead_only_where_spaces_meet():
    """Only chunks with white spaces side by side, or perhaps beyond ASCII, pay for the pattern with a look ahead; nothing looks for an empty special token."""
    enc, t = ByteLevel("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    seen, merge = [], enc.merge
    enc.merge = lambda text: seen.append(text) or merge(text)
    texts = ["one two, three.\nFour five\tsix", "Foo it's é 12 and more ", "a  b c\n\nd e\u00a0f g"]
    ids, _ = enc.encode_column(pa.array(texts))
    assert ids.tolist() == sum((t.encode(x, add_special_tokens=False).ids for x in texts), [])
    assert seen == [" c\n\nd e\u00a0f"]
    assert all(m.func.__self__.special_tokens_set for m in (merge, enc.merge_single))
