"""Token ids of a word-end BPE vocabulary file, many words at a time.

The tokenizer drops white space and merges only inside pieces (runs of letters, single digits, runs of symbols), so
a text's ids are its pieces' ids in turn. Pieces are kept in a bounded cache as packed little-endian 32-bit ids;
those not seen before are merged together in numpy, one merge of every row at a time. Words outside Latin-1, long
pieces and special tokens go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

from .common import give_back

CACHE, LONGEST = 200_000, 24
#: The file's own split for lower-case Latin-1 texts: 0 white space, 1 letters, 2 digits (each alone), 3 other symbols.
_KIND = np.array([0 if chr(c).isspace() and c not in (28, 29, 30, 31) else 1 if chr(c).isalpha() else 2 if unicodedata.category(chr(c))[0] == "N" else 3 for c in range(256)], np.uint8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end = model["end_of_word_suffix"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[shown[b] + end] for b in range(256)], np.int64)
        self.bits = 18
        size = 1 << self.bits
        self.keys, self.rank, self.made = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r, (a, b) in enumerate(merges):
            key = vocab[a] << 20 | vocab[b]
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.rank[at], self.made[at] = key, r, vocab[a + b]
        taken = self.keys >= 0
        runs = np.flatnonzero(np.diff(np.r_[0, taken.astype(int), 0]))
        self.probes = int((runs[1::2] - runs[::2]).max())
        self.pieces: dict[bytes, np.ndarray] = {}
        self.words: dict[bytes, np.ndarray] = {}
        del model, vocab, merges
        give_back()  # the parsed file is many times the tables

    @cached_property
    def whole(self):
        """The library's own tokenizer; plain Latin-1 texts of short pieces never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 11) & ((1 << self.bits) - 1)

    def _lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; a large rank where there is no merge."""
        at = self._slot(key)
        found = self.keys[at]
        rank, made = np.where(found == key, self.rank[at], 1 << 30), self.made[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            here, want = self.keys[at[open_]], key[open_]
            hit = here == want
            rank[open_[hit]], made[open_[hit]] = self.rank[at[open_[hit]]], self.made[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return rank, made

    def _merge(self, pieces: list[str]) -> None:
        """Ids of short pieces of like length into the cache: rows of one matrix, the best merge of each row at a time."""
        raw = [p.encode() for p in pieces]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(lens.max())
        flat = np.frombuffer(b"".join(raw), np.uint8)
        cols = np.arange(width)
        ids = np.full((len(raw), width), -1, np.int64)
        ids[cols < lens[:, None]] = self.inner[flat]
        ids[np.arange(len(raw)), lens - 1] = self.last[flat[np.cumsum(lens) - 1]]
        live, a = np.flatnonzero(lens > 1), ids[lens > 1]
        rank, made = self._pairs(a)
        while len(live):
            at = rank.argmin(axis=1)
            here = np.arange(len(live))
            go = rank[here, at] < 1 << 30
            if not go.all():
                ids[live[~go], : a.shape[1]] = a[~go]
                a, at, rank, made, live = a[go], at[go], rank[go], made[go], live[go]
                here = here[: len(live)]
            if not len(live):
                break
            product = made[here, at]
            keep = np.ones(a.shape, bool)
            keep[here, at + 1] = False
            a = np.concatenate([a[keep].reshape(len(live), -1), np.full((len(live), 1), -1, np.int64)], axis=1)
            a[here, at] = product
            keep = np.ones(rank.shape, bool)
            keep[here, at] = False
            pad = np.full((len(live), 1), 1 << 30, np.int64)
            rank, made = (np.concatenate([x[keep].reshape(len(live), -1), pad], axis=1) for x in (rank, made))
            for side in (-1, 0):  # only the pairs beside the product are new
                col = at + side
                ok = np.flatnonzero((col >= 0) & (col + 1 < a.shape[1]))
                left, right = a[ok, col[ok]], a[ok, np.minimum(col[ok] + 1, a.shape[1] - 1)]
                r, m = self._lookup(left << 20 | np.maximum(right, 0))
                rank[ok, col[ok]], made[ok, col[ok]] = np.where(right >= 0, r, 1 << 30), m
        real = ids >= 0
        flat = ids[real].astype(np.uint32)
        stops = np.cumsum(real.sum(axis=1)).tolist()
        start, known = 0, self.pieces
        for p, stop in zip(pieces, stops):
            known[p.encode("latin-1")] = flat[start:stop].copy()
            start = stop

    def _pairs(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        real = a[:, 1:] >= 0
        rank, made = np.full(real.shape, 1 << 30, np.int64), np.zeros(real.shape, np.int64)
        rank[real], made[real] = self._lookup((a[:, :-1][real] << 20) | a[:, 1:][real])
        return rank, made

    def _learn(self, missing: list[bytes]) -> None:
        """Ids of pieces (Latin-1 bytes) that the cache has not."""
        narrow, mid, wide = [], [], []
        for p in missing:
            s = p.decode("latin-1")
            n = len(s.encode())
            if n > LONGEST:
                self.pieces[p] = self._whole(s)
            else:
                (narrow if n <= 8 else mid if n <= 13 else wide).append(s)
        for some in (narrow, mid, wide):
            for at in range(0, len(some), 20_000):
                self._merge(some[at : at + 20_000])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _mixed(self, text: str) -> np.ndarray:
        """Ids of a text with characters outside Latin-1, apostrophes or special tokens, word by word."""
        out = []
        for w in text.encode("utf-8", "replace").split():
            got = self.words.get(w)
            if got is None:
                if len(self.words) > CACHE // 4:
                    self.words.clear()
                got = self.words[w] = self._whole(w.decode())
            out.append(got)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        plain = [i for i, t in enumerate(texts) if "'" not in t and "<|" not in t and _latin(t)]
        out: list = [None] * len(texts)
        for i, ids in zip(plain, self._encode_latin([texts[i].lower().encode("latin-1") for i in plain])):
            out[i] = ids
        return [self._mixed(t) if ids is None else ids for t, ids in zip(texts, out)]

    def _encode_latin(self, texts: list[bytes]) -> list[np.ndarray]:
        """All texts in one buffer, cut where the kind of character changes; equal pieces are looked up once."""
        if not texts:
            return []
        raw = b"\n".join(texts)
        if not raw:
            return [np.zeros(0, np.uint32)] * len(texts)
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        bounds = np.r_[0, cut, len(data)].astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        unique = coded.dictionary.to_pylist()
        blank = _KIND[np.fromiter((u[0] for u in unique), np.uint8, len(unique))] == 0
        for k in np.flatnonzero(blank):
            unique[k] = b""
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        known = self.pieces
        known[b""] = np.zeros(0, np.uint32)
        missing = [u for u in unique if u not in known]
        if missing:
            self._learn(missing)
        got = [known[u] for u in unique]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat, first = np.concatenate(got), np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(first[at] - (ends - n), n)]
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        after = np.r_[0, ends][np.searchsorted(bounds[:-1], stops[:-1] - 1, side="left")]
        edges = np.r_[0, after, ends[-1]]
        return [ids[edges[k] : edges[k + 1]] for k in range(len(texts))]


def _latin(s: str) -> bool:
    if s.isascii():
        return True
    try:
        s.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One a worker process, with its cache."""
    return WordBpe(path)
