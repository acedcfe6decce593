"""Token counts by a count-only Viterbi search.

An Aho-Corasick automaton lists the vocabulary matches that end at each character, longest first; dynamic
programming carries the best score and its number of pieces, nothing else. A match replaces the best path to
its end only by a strictly better score, which is the tokenizer's rule for ties (see ``pieces``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from ._runtime import text_chunks
from ._words import WordCache, cache_for


@lru_cache(maxsize=2)
def _automaton(path: str):
    import ahocorasick

    found = ahocorasick.Automaton()
    for piece, (_, score) in pieces.load(path).scores.items():
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    return found


def count_unit(unit: str, path: str) -> int:
    """Pieces of one unit's best path."""
    unknown = pieces.load(path).unknown_score
    best, count = [0.0] + [-np.inf] * len(unit), [0] * (len(unit) + 1)
    done = 0  # ends up to here are final

    def unmatched(upto: int):
        """Ends after ``done`` that no single character piece reaches: the character's bytes come last among their matches."""
        nonlocal done
        while done < upto:
            done += 1
            if not single[done]:
                score = best[done - 1] + unknown
                if score > best[done]:
                    best[done], count[done] = score, count[done - 1] + len(unit[done - 1].encode("utf-8", "surrogatepass"))

    single = [False] * (len(unit) + 1)
    for last, (length, score) in _automaton(path).iter(unit):
        end = last + 1
        if end - 1 > done:
            unmatched(end - 1)
        if length == 1:
            single[end] = True
        start = end - length
        score += best[start]
        if score > best[end]:
            best[end], count[end] = score, count[start] + 1
    unmatched(len(unit))
    return count[-1]


def count_texts(texts: list[str], cache: WordCache) -> np.ndarray:
    found, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = pieces.units(pieces.normalise(text))
        sizes[i] = len(own)
        found += own
    if not found:
        return np.zeros(len(texts), np.int64)
    rows, table = cache.lookup(found)
    upto = np.concatenate(([0], np.cumsum(table[rows])))[np.cumsum(sizes)]
    return np.diff(np.concatenate(([0], upto)))


def unit_counts(path: str) -> WordCache:
    return WordCache(lambda found: np.array([count_unit(u, path) for u in found], np.int64))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row's whole text. Null and empty texts have 0; repeated rows count each; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(("unit_counts", path), lambda: unit_counts(path))
        for part, texts in text_chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count_texts(texts, cache), pa.int64())], names=["_id", "n_tokens"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("_id", id_col)
