"""Values dealt anew to places, permutation by permutation, with their sums over neighbours.

Places are numbered and go in chunks. A permutation is a keyed bijection of the numbers, so a row knows by itself where
its value goes: nothing is sorted. Values travel once, packed by chunk; sums over neighbours are made where the
neighbours' values are and travel as one row a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered
from tessera.runtime import checkpoint, free_shuffles

#: Places in a chunk, permutations dealt at once, and neighbour rows summed at once.
CHUNK, _RUNS, _AT_ONCE = 4_096, 64, 1 << 15
_M1, _M2, _ALL = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


def _keys(seed: int, p: int) -> list[np.uint64]:
    keys, z = [], (seed * 0x9E3779B97F4A7C15 + p * 0xD1342543DE82EF95 + 1) & _ALL
    for _ in range(8):
        z = (z + 0x9E3779B97F4A7C15) & _ALL
        k = ((z ^ (z >> 30)) * _M1) & _ALL
        k = ((k ^ (k >> 27)) * _M2) & _ALL
        keys.append(np.uint64(k ^ (k >> 31)))
    return keys


def targets(r: np.ndarray, n: int, seed: int, p: int) -> np.ndarray:
    """Where the values of places ``r`` of 0 to n - 1 go in permutation ``p``; in number 0 they stay.

    Feistel rounds over the bits of n - 1, again for those that end beyond n - 1.
    """
    x = r.astype(np.uint64)
    if not p:
        return x
    bits = max(2, (n - 1).bit_length())
    low = np.uint64(bits // 2)
    masks = np.uint64((1 << (bits - bits // 2)) - 1), np.uint64((1 << (bits // 2)) - 1)
    keys = _keys(seed, p)

    def once(x: np.ndarray) -> np.ndarray:
        halves = [x >> low, x & masks[1]]
        for i, key in enumerate(keys):
            z = (halves[1 - i % 2] ^ key) * np.uint64(_M1)
            z ^= z >> np.uint64(31)
            z *= np.uint64(_M2)
            z ^= z >> np.uint64(29)
            halves[i % 2] = halves[i % 2] ^ (z & masks[i % 2])
        return (halves[0] << low) | halves[1]

    x = once(x)
    while len(out := np.flatnonzero(x >= n)):
        x[out] = once(x[out])
    return x


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def dealt_sums(values: DataFrame, w: DataFrame, permutations: int, seed: int, own: int, finish: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """What ``finish`` makes of each chunk, and the places ``id, x, r`` by number.

    ``finish(first, own, sums, some)`` gets the chunk's first number, the first ``own`` columns of its places' values,
    the sums of weight times value over neighbours, and which places have neighbours. Columns are the values as they
    are, then the permutations. Missing values are NaN, and add nothing to a sum.
    """
    if permutations >= 1 << 16:
        raise ValueError("at most 65,535 permutations")
    places = checkpoint(numbered(values.select("id", F.col("x").cast("double").alias("x")), ["id"], "r"))
    n, runs = places.count(), permutations + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, x = batch["r"].to_numpy(), batch["x"].to_numpy(zero_copy_only=False)
            for first in range(0, runs if len(r) else 0, _RUNS):
                some = range(first, min(first + _RUNS, runs))
                to = np.concatenate([targets(r, n, seed, p) for p in some])
                order = np.argsort((to // CHUNK).astype(np.int32), kind="stable")
                to, p, v = to[order], np.repeat(np.array(some, np.uint16), len(r))[order], np.tile(x, len(some))[order]
                chunk, at = to // CHUNK, (to % CHUNK).astype(np.uint16)
                starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
                yield _batch([(int(chunk[a]), at[a:b].tobytes(), p[a:b].tobytes(), v[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(to)], strict=True)], ["c", "at", "p", "x"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    def height(c: int) -> int:
        return min(CHUNK, n - c * CHUNK)

    def around(key: tuple, dealt: pa.Table, links: pa.Table) -> pa.Table:
        c = key[0].as_py()
        x = np.full((height(c), runs), np.nan)
        for at, p, v in zip(dealt["at"], dealt["p"], dealt["x"], strict=True):
            x[np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(p.as_buffer(), np.uint16)] = np.frombuffer(v.as_buffer())
        rows = [(c, True, b"", np.ascontiguousarray(x[:, :own]).tobytes())]
        x[np.isnan(x)] = 0.0
        i, j, weight = (links[k].to_numpy() for k in ("i", "j", "w"))
        order = np.lexsort((j, i))
        for a in range(0, len(order), _AT_ONCE):
            part = order[a : a + _AT_ONCE]
            ids = i[part]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            sums, ids = np.add.reduceat(x[j[part] - c * CHUNK] * weight[part, None], starts, axis=0), ids[starts]
            cuts = np.flatnonzero(np.r_[True, ids[1:] // CHUNK != ids[:-1] // CHUNK])
            rows += [(int(ids[s] // CHUNK), False, (ids[s:e] % CHUNK).astype(np.uint16).tobytes(), sums[s:e].tobytes()) for s, e in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        return pa.Table.from_batches([_batch(rows, ["c", "own", "at", "s"], [pa.int64(), pa.bool_(), pa.binary(), pa.binary()])])

    def total(key: tuple, parts: pa.Table) -> pa.Table:
        c = key[0].as_py()
        sums, some, mine = np.zeros((height(c), runs)), np.zeros(height(c), bool), None
        for is_own, at, s in zip(parts["own"], parts["at"], parts["s"], strict=True):
            if is_own.as_py():
                mine = np.frombuffer(s.as_buffer()).reshape(-1, own) if own else None
            else:
                at = np.frombuffer(at.as_buffer(), np.uint16)
                sums[at] += np.frombuffer(s.as_buffer()).reshape(-1, runs)
                some[at] = True
        return finish(c * CHUNK, mine, sums, some)

    end = lambda c: places.select(F.col("id").alias(c), F.col("r").alias(f"_{c}"))
    links = w.join(end("i"), "i").join(end("j"), "j").select(F.floor(F.col("_j") / CHUNK).alias("c"), F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("w").cast("double").alias("w"))
    dealt = places.select("r", "x").mapInArrow(deal, "c long, at binary, p binary, x binary")
    parts = dealt.groupBy("c").cogroup(links.groupBy("c")).applyInArrow(around, "c long, own boolean, at binary, s binary")
    out = checkpoint(parts.groupBy("c").applyInArrow(total, schema))
    free_shuffles(values.sparkSession)
    return out, places


def places_beyond(first: int, own: np.ndarray | None, sums: np.ndarray, some: np.ndarray) -> pa.Table:
    """(r, higher, lower): of places with neighbours, how many permutations are at least and at most as high as the values as they are.

    Sums count as they are, or times the place's own value where there is one. What differs in the last bits is equal.
    """
    at = np.flatnonzero(some)
    s = sums[at] if own is None else sums[at] * own[at]
    known, near = ~np.isnan(s[:, 0]), 1e-12 * np.abs(s).max(axis=1, initial=0.0, keepdims=True)
    count = lambda hit: pa.array(hit.sum(axis=1), pa.int64(), mask=~known)
    return pa.table({"r": pa.array(at + first, pa.int64()), "higher": count(s[:, 1:] >= s[:, :1] - near), "lower": count(s[:, 1:] <= s[:, :1] + near)})


def products(first: int, own: np.ndarray, sums: np.ndarray, some: np.ndarray) -> pa.Table:
    """(p, s): the chunk's sum of values times sums over neighbours, by permutation."""
    return pa.table({"p": pa.array(np.arange(sums.shape[1]), pa.int32()), "s": pa.array(np.nansum(own * sums, axis=0))})
