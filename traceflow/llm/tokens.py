"""Token ids of whole texts by a public tokenizer's file, as the tokenizers library gives them without special tokens added.

No merge goes beyond a pre-token, so texts are cut at spaces where a pre-token surely begins; of the chunks of an Arrow column the different
ones are encoded once, and ids are gathered for all. A text that holds an
added token of the file (which the library cuts out first) stays one chunk and goes to the library whole, as do chunks that are
long: a run of white space, say.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import buffers, slices

#: Entries of a generation of the pre-token cache (about 150 bytes each; two generations are kept).
PRETOKENS = 250_000
#: Longer chunks (bytes) are left to the library.
LONG = 1024
#: Bytes of text whose chunks are told apart together (one longer text is taken alone).
SLICE = 6 << 20
#: Pre-tokens of the byte-level file and of the lower-casing file (fixed values of their formats).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two white spaces meet: without a look ahead, which lets tiktoken use its fast automata.
SINGLE_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level files write for each byte: itself where it is printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: a path is taken as it is, a bare name is looked up in public_tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """make(key), remembered: when a generation is full it becomes the old one, from which used entries come back."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class _Chunked:
    """What both files have in common: cutting, gathering, and the library for what can't be cut."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"].encode() for t in json.load(f)["added_tokens"]]

    def _whole(self, text: bytes) -> bytes:
        ids = self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _has_added(self, chunk: bytes) -> bool:
        return any(t in chunk for t in self.added)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, none of them long or with an added token; and how many each has."""
        raise NotImplementedError

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Places of spaces at which a pre-token begins, whatever stands before them."""
        raise NotImplementedError

    def _slice(self, data: np.ndarray, offsets: np.ndarray, of_chunk=None) -> tuple[np.ndarray, ...]:
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        if not len(heads):
            none = np.zeros(len(offsets) - 1, np.int64)
            return np.zeros(0, "<u4"), none, np.zeros(0, np.int64), none
        raw = data.tobytes()
        begins = np.zeros(len(data) + 1, bool)
        begins[self._cuts(data)] = True
        if self._has_added(raw):
            for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if any(raw.find(t, a, z) >= 0 for t in self.added):
                    begins[a:z] = False
        begins[heads] = True
        at = np.flatnonzero(begins[:-1])
        ends = np.append(at, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        which = chunks.indices.to_numpy()
        length = pc.binary_length(chunks.dictionary).to_numpy()
        special = length > LONG
        if self._has_added(raw):
            for t in self.added:
                special |= pc.match_substring(chunks.dictionary, t).to_numpy(zero_copy_only=False)
        ids, size = self._chunks(chunks.dictionary.filter(pa.array(~special)) if special.any() else chunks.dictionary)
        first = np.zeros(len(special), np.int64)
        n = np.zeros(len(special), np.int64)
        n[~special], first[~special] = size, np.cumsum(size) - size
        if special.any():
            blobs = [self._whole(c) for c in chunks.dictionary.filter(pa.array(special)).to_pylist()]
            more = np.array([len(b) // 4 for b in blobs], np.int64)
            n[special], first[special] = more, len(ids) + np.cumsum(more) - more
            ids = np.append(ids, np.frombuffer(b"".join(blobs), "<u4"))
        n = n[which]
        total = np.append(0, np.cumsum(n))
        gathered = ids[np.repeat(first[which] - total[:-1], n) + np.arange(total[-1])]
        first_chunk = np.searchsorted(at, offsets)
        values = of_chunk(chunks.dictionary)[which] if of_chunk else np.zeros(0, np.int64)
        return gathered, np.diff(total[first_chunk]), values, np.diff(first_chunk)

    def encode_column(self, column: pa.Array | pa.ChunkedArray, end_id: int | None = None, of_chunk=None) -> tuple[np.ndarray, ...]:
        """The ids of all texts, one after another, each with end_id behind it if given; and how many each has. Nulls are empty.

        With of_chunk, a function from an array of chunks to a number each, also these numbers of all chunks, and how many chunks each text has.
        """
        data, offsets = buffers(column)
        got = [self._slice(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], of_chunk) for a, z in slices(offsets, SLICE)]
        ids, n, values, chunks = (np.concatenate([np.zeros(0, t), *[g[i] for g in got]]) for i, t in enumerate(("<u4", np.int64, np.int64, np.int64)))
        if end_id is not None:
            out = np.full(len(ids) + len(n), end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            ids, n = out, n + 1
        return (ids, n, values, chunks) if of_chunk else (ids, n)

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian uint32 bytes."""
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()


class ByteLevel(_Chunked):
    """Ids by a byte-level BPE file whose words take the space before them.

    Its merges are in the order of its ids, so tiktoken's merging by rank, which is the faster, gives the same ids. Different chunks are
    encoded as one text, since each begins with a space that begins a pre-token; the lengths of tokens tell them apart again. Chunks
    in which white space stands singly are one such text, by the pattern without a look ahead, the others are another.
    """

    #: Whether a byte may follow a space that begins a pre-token: not ASCII white space or its neighbours, and no byte that begins other white space.
    AFTER = np.array([b not in {*range(9, 14), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3} for b in range(256)])
    SPACE = np.array([b in {*range(9, 14), 32} for b in range(256)])
    #: Bytes that may begin white space beyond ASCII.
    WIDE = np.array([b in {0xC2, 0xE1, 0xE2, 0xE3} for b in range(256)])

    def __init__(self, name: str):
        import tiktoken

        super().__init__(name)
        byte = {c: b for b, c in _LETTERS.items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.library.get_vocab(False).items() if all(c in byte for c in token) and token.encode() not in self.added}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]
        # of no special token at all tiktoken would look for the empty one at every byte; this one isn't allowed, so it stays plain text
        never = {"\0" * LONG: len(self.length)}
        self.merge, self.merge_single = (
            functools.partial(tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=never).encode_to_numpy, disallowed_special=()) for pattern in (BYTE_LEVEL, SINGLE_SPACED)
        )

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(data[:-1] == 32)
        return at[self.AFTER[data[at + 1]]]

    def _single_spaced(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether no two white spaces meet within a chunk, and none beyond ASCII may be in it."""
        white = self.SPACE[data]
        twice = np.append(white[:-1] & white[1:], False)
        twice[offsets[1:] - 1] = False
        out = np.ones(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.flatnonzero(twice | self.WIDE[data]), "right") - 1] = False
        return out

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = buffers(chunks)
        size = np.diff(offsets)
        if not len(size):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        head, second = data[offsets[:-1]], data[np.minimum(offsets[:-1] + 1, len(data) - 1)]
        apart = (head != 32) | (size < 2) | ~self.AFTER[second]  # chunks at a text's beginning
        single = self._single_spaced(data, offsets)
        raw, at = data.tobytes(), offsets.tolist()
        together = [(which, merge) for which, merge in ((~apart & single, self.merge_single), (~apart & ~single, self.merge)) if which.any()]
        try:
            texts = [data[np.repeat(which, size)].tobytes().decode() for which, _ in together]
            alone = [raw[at[i] : at[i + 1]].decode() for i in np.flatnonzero(apart)]
        except UnicodeDecodeError:  # bytes that are no text
            blobs = [self._whole(raw[a:z]) for a, z in zip(at, at[1:])]
            return np.frombuffer(b"".join(blobs), "<u4"), np.array([len(b) // 4 for b in blobs], np.int64)
        got = [merge(x).astype("<u4") for x, (_, merge) in zip(texts, together)]
        n = np.zeros(len(size), np.int64)
        for ids, (which, _) in zip(got, together):
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size[which])) + 1
            n[which] = np.diff(np.append(0, ends))
        more = [(self.merge_single if plain else self.merge)(x).astype("<u4") for x, plain in zip(alone, single[apart].tolist())]
        n[apart] = [len(x) for x in more]
        # one after another in the order of chunks
        out, start = np.empty(int(n.sum()), "<u4"), np.cumsum(n) - n
        for ids, (which, _) in zip(got, together):
            own = n[which]
            out[np.repeat(start[which] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        for a, x in zip(start[apart].tolist(), more):
            out[a : a + len(x)] = x
        return out, n


class WhiteSpaceFree(_Chunked):
    """Ids by a lower-casing BPE file with word ends; no step of it looks across white space."""

    def __init__(self, name: str):
        super().__init__(name)
        self.model = self.library.model
        self.cut = regex.compile(WORD_END).findall
        self.pretokens = _Cache(self._pretoken, PRETOKENS)

    def _pretoken(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word if word.isascii() and word.isalnum() else word.encode("utf-8", "replace").decode("latin-1").translate(_LETTERS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        return np.flatnonzero(data == 32)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        try:
            texts = pc.utf8_trim(chunks.cast(pa.large_string()), " ")
        except pa.ArrowInvalid:  # bytes that are no text
            blobs = [self._whole(c) for c in chunks.to_pylist()]
            return np.frombuffer(b"".join(blobs), "<u4"), np.array([len(b) // 4 for b in blobs], np.int64)
        folded = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts).dictionary_encode()
        get, cut = self.pretokens.__getitem__, self.cut
        blobs = []
        for piece in folded.dictionary.to_pylist():
            if not piece.isascii():
                piece = "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
            if piece.isalpha():
                blobs.append(get(piece))
            elif piece[-1:] in (".", ",") and piece[:-1].isalpha():
                blobs.append(get(piece[:-1]) + get(piece[-1]))
            else:
                blobs.append(b"".join(map(get, cut(piece))))
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        ids, first, which = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(size) - size, folded.indices.to_numpy()
        n = size[which]
        return ids[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


_made: dict = {}


def encoder(kind: type, name: str):
    """One encoder per Python worker, so that its caches last over tasks."""
    if (kind, name) not in _made:
        _made[kind, name] = kind(name)
    return _made[kind, name]
