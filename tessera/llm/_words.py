"""Vectorised word features: a bounded word cache and hashed character n-grams over numpy arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that its high bits depend on all of it."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


#: Words whose n-grams are made at once; bounds the memory that takes.
_AT_ONCE = 8_192


def char_ngrams(words: Sequence[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the character n-grams (``low`` to ``high``) of '<word>' and of the whole word.

    Returns the ids of all words one after another and each word's number of ids. N-grams that touch a
    bracket are the word's affixes; bracket code points are outside Unicode, so no text can forge them.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if n > _AT_ONCE:
        parts = [char_ngrams(words[i : i + _AT_ONCE], low, high, bits) for i in range(0, n, _AT_ONCE)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    lengths = np.fromiter(map(len, words), np.int64, n) + 2
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    code = np.empty(int(ends[-1]), np.uint64)
    inner = np.ones(len(code), bool)
    inner[starts] = inner[ends - 1] = False
    code[inner] = chars
    code[starts], code[ends - 1] = 0x110001, 0x110002
    left = np.repeat(ends, lengths) - np.arange(len(code))  # code points up to the word's end, this one included
    owner = np.repeat(np.arange(n), lengths)
    out, own, h = [], [], np.zeros(len(code), np.uint64)
    for k in range(1, high + 1):
        h = h[: len(code) - k + 1] * _STEP + mix(code[k - 1 :] + np.uint64(k))
        if k >= low:
            fits = left[: len(h)] >= k
            out.append(mix(h[fits]))
            own.append(owner[: len(h)][fits])
    position = (np.arange(len(code)) - np.repeat(starts, lengths)).astype(np.uint64)
    out.append(mix(np.add.reduceat(mix(code + position * _MIX), starts) + np.uint64(7)))
    own.append(np.arange(n))
    ids, owners = np.concatenate(out), np.concatenate(own)
    order = np.argsort(owners, kind="stable")
    return (ids[order] >> np.uint64(64 - bits)).astype(np.int32), np.bincount(owners, minlength=n)


class WordCache(dict):
    """word -> row number; rows are computed for all new words of a batch at once.

    Holds at most about ``limit`` words and 40 characters for each, so that a worker's memory does not follow
    the vocabulary. When it is full, the words met more than once stay (at most half of the limit, the most
    used first) and the others go. Values depend on the word alone, never on the cache.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], limit: int = 400_000, kept: Callable[[np.ndarray], np.ndarray] = lambda rows: rows):
        """``kept``: gets the rows that stay and returns what they become."""
        super().__init__()
        self.compute, self.limit, self.kept, self.new, self.size = compute, limit, kept, [], 0
        self.rows: np.ndarray | None = None
        self.uses = np.zeros(0, np.int64)
        self.filled = 0

    def __missing__(self, word):
        self[word] = row = len(self)
        self.new.append(word)
        self.size += len(word)
        return row

    def _shrink(self) -> None:
        uses = self.uses[: self.filled]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: self.limit // 2]])
        words = list(self)
        words = [words[i] for i in keep.tolist()]
        if sum(map(len, words)) > 20 * self.limit:
            keep, words = keep[:0], []
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        rows = self.kept(self.rows[keep])
        self.rows[: len(rows)], self.filled, self.size = rows, len(rows), sum(map(len, words))
        self.uses[: len(rows)] = 0
        self.uses[len(rows) :] = 0

    def lookup(self, words: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of ``words`` and the table of rows."""
        if len(self) > self.limit or self.size > 40 * self.limit:
            self._shrink()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new or self.rows is None:
            fresh = self.compute(self.new)
            need = self.filled + len(fresh)
            if self.rows is None:
                self.rows = np.empty((0, *fresh.shape[1:]), fresh.dtype)
            if need > len(self.rows):
                grown = np.empty((max(1024, 2 * need), *fresh.shape[1:]), fresh.dtype)
                grown[: self.filled] = self.rows[: self.filled]
                self.rows = grown
                self.uses = np.concatenate([self.uses, np.zeros(len(grown) - len(self.uses), np.int64)])
            self.rows[self.filled : need] = fresh
            self.filled = need
            self.new = []
        self.uses[: self.filled] += np.bincount(ids, minlength=self.filled)
        return ids, self.rows


_CACHES: dict = {}


def give_back() -> None:
    """Return freed memory to the system. Allocators keep it in gaps between what lives on, so a worker that goes from stage to stage would grow with each."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def cache_for(key, make: Callable[[], WordCache]) -> WordCache:
    """This worker's cache for a model. Workers go on to other stages, so the caches of other models are let go, and their memory is given back."""
    if key not in _CACHES:
        _CACHES.clear()
        give_back()
        _CACHES[key] = make()
    return _CACHES[key]


class IdStore:
    """Ids of words in one flat array; a cache's rows are (start, size) in it."""

    def __init__(self, ids_of: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        """``ids_of``: all ids of some words one after another, and each word's number of ids."""
        self.ids_of, self.flat, self.used = ids_of, np.zeros(1 << 16, np.uint32), 0
        self.words = WordCache(self._add, limit, self._compact)

    def _add(self, words: list) -> np.ndarray:
        if not words:
            return np.zeros((0, 2), np.int64)
        got, sizes = self.ids_of(words)
        total = len(got)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * total, np.uint32)])
        self.flat[self.used : self.used + total] = got
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += total
        return np.stack([starts, sizes], axis=1)

    def _gather(self, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]

    def _compact(self, rows: np.ndarray) -> np.ndarray:
        starts, sizes = rows[:, 0], rows[:, 1]
        ends = np.cumsum(sizes)
        stay = self._gather(starts, sizes, ends)
        self.flat[: len(stay)], self.used = stay, len(stay)
        return np.stack([ends - sizes, sizes], axis=1)

    def ids(self, words: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after another and each text's number of ids, from all their words and each text's number of words."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        rows, table = self.words.lookup(words)
        starts, sizes = table[rows, 0], table[rows, 1]
        ends = np.cumsum(sizes)
        upto = np.concatenate(([0], ends))[np.cumsum(counts)]
        return self._gather(starts, sizes, ends), np.diff(np.concatenate(([0], upto)))


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as IdStore takes them."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum())), sizes
