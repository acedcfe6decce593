"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most ``d`` bits agree in
at least ``8 - d`` positions, the guaranteed minimum. Single-byte lists hold a 256th of all fingerprints
each, so the index lists are keyed by all subsets of ``7 - d`` positions with their bytes (four of eight for
``d = 3``): a pair that reaches the minimum shares several such lists, but a pair of a list need not reach it.
In a list the shared positional bytes of each pair are tallied, pairs under the minimum go, and only the pairs
that are left are verified bit by bit. A long list is dealt once more by each further position: its pairs that
reach the minimum agree there in at least one. Such a part holds at most 2**24 different fingerprints for
``d = 3``, and if it is still long, it is probed for all fingerprints within ``d`` bits, with the same links.

Equal fingerprints are one node. A list yields no more links than it has fingerprints: its verified pairs
are reduced to a spanning forest at once, which keeps every connection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._runtime import checkpoint, text_chunks
from .components import components

WORDS, SEED, MAX_BITS = 3, 42, 3
#: Lists up to SHORT are compared together, up to PAIRWISE pair by pair; longer ones are dealt by a further position, then probed (a fixed number of steps a fingerprint).
SHORT, PAIRWISE = 8, 2_048
_HASHES = 1 << 16


def _bit_majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``counts`` hashes: bits set in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").reshape(-1, 8).view("<u8").ravel()


def fingerprint_texts(texts: list[str], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of whole texts: A-Z lower-cased, split at ASCII white space, shingles of ``words`` words, XXH64, bit majority."""
    out = np.zeros(len(texts), np.uint64)
    digest, pending, counts, rows = xxhash.xxh64_intdigest, [], [], []

    def flush():
        if rows:
            out[rows] = _bit_majority(np.array(pending, np.uint64), np.array(counts, np.int64))
        pending.clear(), counts.clear(), rows.clear()

    for i, text in enumerate(texts):
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            continue
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(words, len(tokens))
        spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
        hashes = [digest(joined[a:b], seed) for a, b in spans]
        if len(hashes) > _HASHES:  # one long text: sum its bits in blocks
            total = np.zeros(64, np.int64)
            for at in range(0, len(hashes), _HASHES):
                block = np.array(hashes[at : at + _HASHES], "<u8").view(np.uint8).reshape(-1, 8)
                total += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]
            continue
        pending += hashes
        counts.append(len(hashes))
        rows.append(i)
        if len(pending) > _HASHES:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed 64-bit integer; a text without words (null, empty, blank) has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_texts(texts, words, seed).view(np.int64))], names=["_id", "fp"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def _with_prints(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` with a column ``_print``, the fingerprint of ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprint_texts(texts, words).view(np.int64))], names=[*part.schema.names, "_print"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_print", LongType())]))


def _masks(max_bits: int) -> list[int]:
    """One mask for every choice of ``7 - max_bits`` byte positions (at least one)."""
    return [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), max(1, 7 - max_bits))]


def _tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair shares."""
    return 8 - np.count_nonzero(np.ascontiguousarray(x ^ y)[..., None].view(np.uint8), axis=-1)


def _linked(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification: pairs that share at least ``8 - max_bits`` positional bytes are retained, and of those the ones that differ in at most ``max_bits`` bits are linked."""
    linked = _tally(x, y) >= 8 - max_bits
    retained = np.nonzero(linked)
    linked[retained] = np.bitwise_count((x ^ y)[retained]) <= max_bits
    return linked


def _list_links(fps: np.ndarray, mask: int, max_bits: int) -> tuple[list, list]:
    """Links that connect one list of different fingerprints as all its links do; at most one a fingerprint, or one for each position that the list is dealt by."""
    if len(fps) > PAIRWISE and mask.bit_count() < 8 * (8 - max_bits):
        left, right = [], []
        for p in range(8):
            if not mask >> (8 * p) & 1:
                byte = (fps >> np.uint64(8 * p)).astype(np.uint8)
                order = np.argsort(byte, kind="stable")
                ends = np.cumsum(np.bincount(byte, minlength=256)).tolist()
                for a, b in zip([0, *ends], ends, strict=False):
                    if b - a > 1:
                        x, y = _list_links(fps[order[a:b]], mask | 0xFF << (8 * p), max_bits)
                        left += x
                        right += y
        return left, right
    left, right, rest = [], [], np.sort(fps)
    probes = None
    if len(rest) > PAIRWISE:
        free = [np.uint64(1 << b) for b in range(64) if not mask >> b & 1]
        flips = [np.bitwise_or.reduce(np.array(c, np.uint64)) for k in range(1, max_bits + 1) for c in combinations(free, k)]
        probes = np.array(flips, np.uint64)
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            if probes is not None and len(rest) > PAIRWISE:
                for at in range(0, len(frontier), 256):
                    seen = (frontier[at : at + 256, None] ^ probes).ravel()
                    place = np.minimum(np.searchsorted(rest, seen), len(rest) - 1)
                    near[place[rest[place] == seen]] = True
            else:
                step = max(1, (1 << 20) // len(rest))
                for at in range(0, len(frontier), step):
                    near |= _linked(frontier[at : at + step, None], rest, max_bits).any(axis=0)
            frontier, rest = rest[near], rest[~near]
            left += [root] * len(frontier)
            right += frontier.tolist()
    return left, right


def _find_links(max_bits: int):
    masks = np.array(_masks(max_bits), np.uint64)

    def links_of(combo: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """Links of whole lists that lie one after another."""
        key = fps & masks[combo]
        first = np.flatnonzero(np.concatenate(([True], (combo[1:] != combo[:-1]) | (key[1:] != key[:-1]))))
        sizes = np.diff(np.append(first, len(fps)))
        a, b = [], []
        short = np.where(sizes <= SHORT, sizes, 1)
        left_in_list = np.repeat(first + short, sizes) - np.arange(len(fps))  # members of a short list from here on, this one included
        for apart in range(1, SHORT):
            x = np.flatnonzero(left_in_list > apart)
            x = x[_linked(fps[x], fps[x + apart], max_bits)]
            a.append(fps[x])
            b.append(fps[x + apart])
        for start, size in zip(first[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
            x, y = _list_links(fps[start : start + size], int(masks[combo[start]]), max_bits)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64)) for s in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_combo, kept_fps = [], []  # the last list may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            combo = batch.column(0).to_numpy().astype(np.int64)
            fps = batch.column(1).to_numpy().view(np.uint64)
            key = fps & masks[combo]
            same = (combo == combo[-1]) & (key == key[-1])
            whole = len(fps) - int(np.argmin(same[::-1])) if not same.all() else 0
            if not whole and kept_fps and (kept_combo[-1][-1] != combo[0] or kept_fps[-1][-1] & masks[combo[0]] != key[0]):
                yield links_of(np.concatenate(kept_combo), np.concatenate(kept_fps))
                kept_combo, kept_fps = [], []
            if whole:
                yield links_of(np.concatenate([*kept_combo, combo[:whole]]), np.concatenate([*kept_fps, fps[:whole]]))
                kept_combo, kept_fps = [], []
            kept_combo.append(combo[whole:])
            kept_fps.append(fps[whole:])
        if kept_fps:
            yield links_of(np.concatenate(kept_combo), np.concatenate(kept_fps))

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the different fingerprints ``distinct(fp)`` exactly as all pairs within ``max_bits`` bits do."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in _masks(max_bits)])
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.rdd.getNumPartitions())
    postings = distinct.repartition(tasks, "fp").select(F.posexplode(masks).alias("combo", "mask"), "fp")
    postings = postings.select(F.col("combo").cast("short").alias("combo"), "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    dealt = postings.repartition("combo", "key").sortWithinPartitions("combo", "key").select("combo", "fp")
    return dealt.mapInArrow(_find_links(max_bits), "a long, b long")


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int) -> DataFrame:
    """(id, fp, root, component_id) of every row; root is the component's smallest fingerprint."""
    prints = checkpoint(fingerprints(docs, id_col, text_col, words))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(fingerprint_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # its own checkpoint lets the join deal both sides itself: AQE then splits the rows of a large component
    least = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpoint(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select(id_col, "fp", "root", "component_id")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Texts shorter than ``words`` words have one shingle, their whole word sequence; null, empty and blank texts
    have fingerprint zero and are linked like any other. Repeated rows and ties share one fingerprint. Null
    ids never become a component_id unless a component has no other. An empty table gives no rows; other columns
    are ignored.
    """
    out = _rooted(docs, id_col, text_col, words, max_bits)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the one with the smallest id.

    A null id loses to any other. Of several rows with that id, as of rows without any id, the smallest by all
    columns stays (which must then be sortable); an id that stands for several texts is judged for each of them.
    Null, empty and blank texts are one component; an empty table stays empty.
    """
    found = checkpoint(_rooted(docs, id_col, text_col, words, max_bits).withColumnRenamed(id_col, "_found"))
    once = found.groupBy("_found").agg(F.count(F.lit(1)).alias("_rows"), F.max(~F.col("_found").eqNullSafe(F.col("component_id"))).alias("_copy"))
    out = checkpoint(once.where(F.col("_copy") | (F.col("_rows") > 1)))
    kept = docs.join(out.select("_found"), docs[id_col].eqNullSafe(out["_found"]), "left_anti")
    again = out.where(F.col("_rows") > 1).select("_found")
    if again.isEmpty():
        return kept
    # ids of several rows, as a rule few: their fingerprints are worked out anew to tell their rows apart
    rows = docs.join(again, docs[id_col].eqNullSafe(again["_found"]), "left_semi")
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    printed = checkpoint(_with_prints(whole, words))
    places = found.where(F.col("_found").eqNullSafe(F.col("component_id"))).select("_found", F.col("fp").alias("_fp"), "root").distinct()
    chosen = printed.join(places, F.col("_id").eqNullSafe(F.col("_found")) & (F.col("_print") == F.col("_fp"))).groupBy("root", "_id").agg(F.min("_row").alias("_row"))
    return kept.unionByName(chosen.select("_row.*"))
