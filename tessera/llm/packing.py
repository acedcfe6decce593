"""Packing token sequences by cutting-stock column generation.

Each document's ids are cut into full sequences of ``capacity`` ids and one remainder. Remainders are
counted by length class (``grain`` ids wide, rounded up), a histogram whose size depends on the capacity
alone. On the driver a linear program over packing patterns is solved by column generation: a revised simplex
method whose entering patterns an unbounded knapsack dynamic program prices. Patterns are used the rounded-down
number of times, the few pieces left over are packed best-fit by class. The workers then rank the pieces of
each class (salted, with offsets from a small count table) and find sequence and slot from the rank. Pieces of
the longest class fill a sequence each and need no rank.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import checkpoint, text_chunks
from ._words import IdStore, cache_for, joined

CAPACITY, END_ID, GRAIN = 2048, 1, 8
#: Groups into which each length class is dealt for ranking: at least so many, and so many that one has about RANKED rows.
RANK_SALTS, RANKED = 64, 250_000
#: Words whose ids a worker keeps.
CACHED_WORDS = 800_000
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{1,64}[.,]?")


def tokenizer_path() -> str:
    """Where the installed vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    """Of each id, whether its piece ends a word."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
    return out


class TokenIds:
    """Ids of whole texts from the ids of their white-space separated words.

    The tokenizer drops white space, and neither its normaliser nor its pre-tokenizer joins characters across
    ASCII white space, so a text's ids are its words' ids one after another. Words are encoded once and kept,
    up to ``limit`` of them.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        self.path, self.store = path, IdStore(self._encode, limit)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Most new words are plain: Latin letters, then perhaps a full stop or comma, so one or two pre-tokens, each of
        which ends with a piece that ends a word. Those are encoded many at a time and told apart by such pieces."""
        coder, texts = _tokenizer(self.path), [w.decode("utf-8", "replace") for w in words]
        plain = np.fromiter((_PLAIN.fullmatch(t) is not None for t in texts), bool, len(texts))
        sizes, parts = np.zeros(len(texts), np.int64), []
        chosen = np.flatnonzero(plain)
        if len(chosen):
            lines = [" ".join([texts[i] for i in chosen[at : at + 500]]) for at in range(0, len(chosen), 500)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in coder.encode_batch_fast(lines, add_special_tokens=False)])
            pre_tokens = np.fromiter((2 if texts[i][-1] in ".," else 1 for i in chosen), np.int64, len(chosen))
            ends = np.flatnonzero(_word_ends(self.path)[flat])
            if len(ends) != pre_tokens.sum():
                raise ValueError("the tokenizer does not end words as expected")
            upto = ends[np.cumsum(pre_tokens) - 1] + 1
            sizes[chosen] = np.diff(np.concatenate(([0], upto)))
            parts.append((chosen, flat))
        others = np.flatnonzero(~plain)
        if len(others):
            flat, sizes[others] = joined([e.ids for e in coder.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)])
            parts.append((others, flat))
        out, starts = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for which, flat in parts:
            n = sizes[which]
            out[np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(len(flat))] = flat
        return out, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after another, and each text's number of ids."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = text.encode("utf-8", "replace").split()
            counts[i] = len(own)
            words += own
        return self.store.ids(words, counts)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's ids, an end id after them, cut every ``capacity`` ids.

    Null and empty texts have the end id alone. Repeated rows are cut each; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = cache_for(("token_ids", path), lambda: TokenIds(path))
        for part, texts in text_chunks(batches, "_text"):
            ids, counts = coder.encode(texts)
            at, row, start, length, crc, total = 0, [], [], [], [], []
            for i, n in enumerate(counts.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for s in range(0, n + 1, capacity):
                    cut = own[s : s + capacity]
                    row.append(i), start.append(s), length.append(len(cut)), crc.append(zlib.crc32(cut.tobytes())), total.append(n + 1)
            columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {source.schema['_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _knapsack(values: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Best value of a sequence of ``units``, and how often it holds each class; class k takes k + 1 units."""
    best, choice = np.zeros(units + 1), np.full(units + 1, -1, np.int64)
    for u in range(1, units + 1):
        gains = values[:u] + best[u - 1 :: -1][:u]
        k = int(np.argmax(gains))
        best[u], choice[u] = best[u - 1], -1
        if gains[k] > best[u] + 1e-12:
            best[u], choice[u] = gains[k], k
    pattern, u = np.zeros(len(values), np.int64), units
    while u > 0:
        if choice[u] < 0:
            u -= 1
        else:
            pattern[choice[u]] += 1
            u -= choice[u] + 1
    return float(best[units]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse with row pivots, against the rounding that updates gather."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        best = k + int(np.argmax(np.abs(work[k:, k])))
        work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= np.outer(factor, work[k])
    return work[:, n:]


def solve_patterns(demand: np.ndarray, rounds: int = 6_000, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often the linear program uses each, for ``demand[k]`` pieces of k + 1 units in sequences of ``len(demand)`` units.

    Stops when no pattern prices out by more than ``gap`` (within that share of the optimum) or after
    ``rounds`` pivots; either way the uses satisfy the demand exactly.
    """
    units = len(demand)
    live = np.flatnonzero(demand > 0)
    if not len(live):
        return np.zeros((0, units), np.int64), np.zeros(0)
    d = demand[live].astype(float)
    each = units // (live + 1)
    columns = np.diag(each).astype(float)  # start: sequences of one class
    inverse, uses = np.diag(1.0 / each), d / each
    for step in range(rounds):
        price = inverse.sum(axis=0)  # dual values; each pattern costs one
        values = np.zeros(units)
        values[live] = price
        worth, pattern = _knapsack(np.maximum(values, 0), units)
        if worth <= 1 + gap:
            break
        entering = pattern[live].astype(float)
        direction = np.einsum("ij,j->i", inverse, entering)  # einsum: no threaded BLAS beside the JVM
        positive = direction > 1e-9
        if not positive.any():
            break
        ratios = np.where(positive, uses / np.where(positive, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        theta = max(0.0, ratios[out])
        uses -= theta * direction
        uses[out] = theta
        columns[:, out] = entering
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if step % 200 == 199:
            inverse = _inverse(columns)
            uses = np.maximum(np.einsum("ij,j->i", inverse, d), 0)
    full = np.zeros((len(live), units), np.int64)
    full[:, live] = columns.T.round().astype(np.int64)
    return full, np.maximum(uses, 0)


def plan_sequences(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer plan: (patterns, uses) that hold exactly ``demand[k]`` pieces of k + 1 units; the last rows pack what rounding left over."""
    units = len(demand)
    patterns, uses = solve_patterns(demand)
    whole = np.floor(uses + 1e-6).astype(np.int64)
    rest = demand - whole @ patterns if len(patterns) else demand.copy()
    for p in np.flatnonzero(whole):  # rounding up by 1e-6 must not overdraw a class
        while (over := np.flatnonzero((rest < 0) & (patterns[p] > 0))).size and whole[p]:
            whole[p] -= 1
            rest += patterns[p]
    out, times = list(patterns[whole > 0]), whole[whole > 0].tolist()
    while rest.any():  # the largest piece left, then the largest that still fits, as often as that pattern can repeat
        room, pattern, left = units, np.zeros(units, np.int64), rest.copy()
        while room and (fit := np.flatnonzero(left[:room])).size:
            k = int(fit[-1])
            n = min(int(left[k]), room // (k + 1))
            pattern[k] += n
            left[k] -= n
            room -= n * (k + 1)
        held = pattern > 0
        n = int((rest[held] // pattern[held]).min())
        out.append(pattern)
        times.append(n)
        rest = rest - n * pattern
    return np.array(out, np.int64).reshape(-1, units), np.array(times, np.int64)


def _assign(plan: tuple[np.ndarray, np.ndarray]):
    """For each class: where each pattern's share of its ranks begins, the first sequence of that pattern, its repeats, and its first slot."""
    patterns, times = plan
    first = np.cumsum(times) - times
    table = {}
    for k in range(patterns.shape[1]):
        p = np.flatnonzero(patterns[:, k])
        share = times[p] * patterns[p, k]
        slot = np.array([patterns[q, :k].sum() for q in p], np.int64)
        table[k] = (np.cumsum(share) - share, first[p], times[p], slot)
    return table


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, grain: int = GRAIN) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone; texts of any length are cut whole. Repeated rows are packed once
    for each row. Pieces of a sequence lie gaplessly from offset 0. Which of several equally long pieces goes
    where follows a hash of the id and the start; pieces that fill a sequence are numbered after the others,
    by where they were written, with gaps. Other columns are ignored; an empty table gives no rows.
    """
    cut = checkpoint(pieces(docs, path, id_col, text_col, capacity, end_id))
    units = -(-capacity // grain)
    classed = cut.select("*", F.floor((F.col("length") + grain - 1) / grain).cast("int").alias("_class"))
    shared = classed.where(F.col("_class") < units)
    demand = np.zeros(units, np.int64)
    for r in shared.groupBy("_class").count().collect():  # at most capacity / grain rows
        demand[r["_class"] - 1] = r["count"]
    salts = np.concatenate(([1], np.maximum(RANK_SALTS, -(-demand // RANKED))))
    salted = shared.withColumn("_salt", F.pmod(F.xxhash64(id_col, "start"), F.element_at(F.array(*[F.lit(int(n)) for n in salts]), F.col("_class") + 1)).cast("int"))
    starts = np.cumsum(salts) - salts
    tally = np.zeros(int(salts.sum()), np.int64)
    for r in salted.groupBy("_class", "_salt").count().collect():  # a row for RANKED pieces, and capacity / grain x RANK_SALTS
        tally[starts[r["_class"]] + r["_salt"]] = r["count"]
    base = np.cumsum(tally) - tally
    base -= np.repeat(base[starts], salts)
    plan = plan_sequences(demand)
    table, sequences = _assign(plan), int(plan[1].sum())
    w = "row_number() over (partition by _class, _salt order by length, {0}, start, ids_crc32) - 1".format(f"`{id_col}`")
    ranked = salted.withColumn("_rank", F.expr(w).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_class", "_salt", "_rank"))
            rank = rank + base[starts[kind] + salt]
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(kind):
                at = np.flatnonzero(kind == k)
                begins, first, times, slots = table[int(k) - 1]
                p = np.searchsorted(begins, rank[at], side="right") - 1
                within = rank[at] - begins[p]
                sequence[at], slot[at] = first[p] + within % times[p], slots[p] + within // times[p]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], names=[*batch.schema.names[:5], "sequence_id", "_slot"])

    schema = f"{id_col} {cut.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _slot long"
    placed = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "_class", "_salt", "_rank").mapInArrow(run, schema)
    before = "coalesce(sum(length) over (partition by sequence_id order by _slot rows between unbounded preceding and 1 preceding), 0)"
    packed = placed.withColumn("offset", F.expr(before).cast("long")).drop("_slot")
    alone = classed.where(F.col("_class") == units).drop("_class")
    return packed.unionByName(alone.select("*", (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
