"""Byte-level BPE with a segment tree per word.

A word's bytes are the leaves' places; every node of its tree holds the leftmost least rank of
the neighbouring pairs below it. A merge takes the root's pair, drops the right part and updates
the two live neighbours' pairs on the way up. All words of a length class are merged together,
their trees being the columns of one array.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = np.int64(1 << 62)
#: Leaves handled at once; their trees stay in the cache.
WORK = 1 << 16
BEYOND = re.compile("[\U00010000-\U0010ffff]").search


@lru_cache(2)
def _classes(last: int) -> tuple[str, str]:
    """Character classes of letters and of numbers up to the code point `last`, taken from the `regex` module."""
    import regex

    every = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)

    def ranges(prop: str) -> str:
        return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(rf"\p{{{prop}}}+", every))

    return ranges("L"), ranges("N")


@lru_cache(4)
def word_pattern(last: int = sys.maxunicode) -> re.Pattern[str]:
    """The public pattern of byte-level BPE, in classes that `re` has, for texts without code points above `last`.

    `re` looks a class up in a table within the basic plane and in a list of ranges beyond it.
    """
    letters, numbers = _classes(last)
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def default_vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of a public vocabulary; the folder is the package `public_tokenizers` unless a path is given."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


class Bpe:
    """The words' ids, with those of words already seen kept up to `keep` words."""

    def __init__(self, path: str, keep: int = 400_000):
        lines = Path(path).read_bytes().split(b"\n")
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.keep, self.known = keep, {}
        self._pairs()

    def _pairs(self) -> None:
        """Hash table (left id, right id) -> rank of the merged token, over every split of every token into two tokens."""
        keys, vals = [], []
        get = self.ranks.get
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    keys.append(a << 16 | b)
                    vals.append(r)
        k, v = np.array(keys, np.int64), np.array(vals, np.int64)
        bits = 1
        while 1 << bits < 4 * len(k):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.slots, self.values = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, NONE, np.int64)
        at = self._slot(k)
        left = np.arange(len(k))
        while len(left):  # linear probing, all keys at once
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]][::-1]] = k[left[free]][::-1]
            won = self.slots[at[left]] == k[left]
            self.values[at[left[won]]] = v[left[won]]
            left = left[~won]
            at[left] += 1

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 16 | b
        at = self._slot(k)
        out = self.values[at]
        miss = np.flatnonzero((self.slots[at] != k) & (self.slots[at] >= 0))
        out[self.slots[at] != k] = NONE
        while len(miss):
            at[miss] += 1
            s = self.slots[at[miss]]
            hit = miss[s == k[miss]]
            out[hit] = self.values[at[hit]]
            miss = miss[(s != k[miss]) & (s >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian int32 bytes."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            else:
                groups.setdefault((len(w) - 1).bit_length(), []).append(i)
        for level, rows in sorted(groups.items()):
            step = max(1, WORK >> level)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_class([words[j] for j in part], 1 << level)):
                    out[i] = ids
        return out

    def _merge_class(self, words: list[bytes], size: int) -> list[bytes]:
        n = len(words)
        level = size.bit_length() - 1
        kind = np.int32 if size <= 1 << 14 else np.int64
        none = np.iinfo(kind).max
        lens = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        ids = self.of_byte[raw]
        place = np.arange(size)
        inside = place < lens[:, None]
        ids[~inside] = -1
        after = np.broadcast_to(place + 1, (n, size)).copy()
        before = np.broadcast_to(place - 1, (n, size)).copy()
        # Leaf i holds rank * size + i of the pair that starts at place i, so the least is the leftmost of the least rank.
        tree = np.full((n, 2 * size), none, kind)
        if size > 1:
            pair = place[:-1] + 1 < lens[:, None]
            r = np.full((n, size - 1), NONE, np.int64)
            r[pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
            tree[:, size : 2 * size - 1] = np.where(r < NONE, r * size + place[:-1], none)
        w = size
        while w > 1:
            tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
            w //= 2
        flat_t, flat_i, flat_a, flat_b = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            root = flat_t[live * (2 * size) + 1].astype(np.int64)
            rank, at = root >> level, root & (size - 1)
            base, tbase = live * size, live * (2 * size)
            right = flat_a[base + at]
            end = flat_a[base + right]
            flat_i[base + at] = rank
            flat_i[base + right] = -1
            flat_a[base + at] = end
            ok = end < lens[live]
            flat_b[base[ok] + end[ok]] = at[ok]
            prev = flat_b[base + at]
            has = prev >= 0
            # The dropped part's pair, the merged part's pair and that of its left neighbour.
            flat_t[tbase + size + right] = none
            mine = np.full(len(live), none, kind)
            if ok.any():
                r = self.rank(rank[ok], flat_i[base[ok] + end[ok]])
                mine[ok] = np.where(r < NONE, r * size + at[ok], none)
            flat_t[tbase + size + at] = mine
            if has.any():
                r = self.rank(flat_i[base[has] + prev[has]], rank[has])
                flat_t[tbase[has] + size + prev[has]] = np.where(r < NONE, r * size + prev[has], none)
            node = [(tbase, (size + right) >> 1), (tbase, (size + at) >> 1), (tbase[has], (size + prev[has]) >> 1)]
            w = size
            while w > 1:
                for j, (tb, x) in enumerate(node):
                    k = tb + 2 * x
                    flat_t[tb + x] = np.minimum(flat_t[k], flat_t[k + 1])
                    node[j] = (tb, x >> 1)
                w >>= 1
            live = live[flat_t[tbase + 1] < none]
        keep = ids >= 0
        counts = keep.sum(1)
        data = ids[keep].astype("<i4").tobytes()
        ends = np.cumsum(counts) * 4
        return [data[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist())]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has)."""
        near, far = word_pattern(0xFFFF).findall, word_pattern().findall
        words = [(far if BEYOND(t) else near)(t) if t else [] for t in texts]
        known = self.known
        fresh = list({w for ws in words for w in ws if w not in known})
        if len(known) + len(fresh) > self.keep:
            known.clear()
            fresh = list({w for ws in words for w in ws})
        known.update(zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])))
        get = known.__getitem__
        parts = [b"".join(map(get, ws)) for ws in words]
        return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One per Python worker, so that words seen in an earlier task are known in the next."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Rows (key, ids ARRAY<INT>): each text's ids without special tokens; null and empty texts have an empty list.

    Strings of special tokens are ordinary text. One row out per row in, repeated rows too; no shuffle.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            ids, n = bpe.encode(b.column(1).to_pylist())
            ends = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=ends[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Rows (key, n_tokens INT): how many ids each text has."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            _, n = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens int")
