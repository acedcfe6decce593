"""SentencePiece encoding and decoding with a weighted finite-state transducer in the tropical semiring.

Compiled from a model's pieces: the normaliser maps a space to the space mark and every other character to
itself; the piece transducer is a trie whose final states go back to the start and emit the piece; the byte
fallback emits a character's byte pieces where the character is no piece. Normaliser and pieces are composed
once. Each input is a linear acceptor; its composition is explored lazily, position by position, and since it
has no cycles one pass of relaxations gives the shortest path.

For a unigram model an emitted piece costs minus its score, and only a strictly lower cost replaces a path (see
``pieces``). For a byte-pair model a third transducer, whose states are the last piece, joins the composition: a
piece after a piece costs nothing if merging their joint text by rank gives just those two, and infinitely much
otherwise. A sequence of pieces is what merging gives exactly if that holds for each of its neighbours, so every
prefix has one path of finite cost and the shortest path is the byte-pair encoding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from ._runtime import text_chunks
from ._words import IdStore, cache_for, joined

#: Output label and cost of a state's arc back to the start, beside its arcs by character.
_FINAL = 0


#: Neighbours whose cost is kept.
_PAIRS = 500_000


class Transducer:
    """States are dicts from an input character to the next state; ``_FINAL`` holds (piece id, cost) where a piece ends."""

    def __init__(self, vocabulary: pieces.Vocabulary, kind: str = "bpe"):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model {kind}")
        self.root: dict = {}
        self.scores = {piece: score for piece, (_, score) in vocabulary.scores.items()}
        for piece, (label, score) in vocabulary.scores.items():
            state = self.root
            for char in piece:
                state = state.setdefault(char, {})
            if kind == "unigram" or self._merged(piece) == [piece]:  # what merging never makes is no piece to emit
                state[_FINAL] = (label, -score)
        self._compose_normaliser(self.root)
        self.byte_ids, self.fallback_cost = vocabulary.byte_ids, -vocabulary.unknown_score
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shortest_path = self._byte_pair_path if kind == "bpe" else self._unigram_path

    def _compose_normaliser(self, state: dict) -> None:
        """Normaliser o pieces: wherever a space mark leads on, so does a space. The normaliser has one state, so states stay."""
        waiting = [state]
        while waiting:
            state = waiting.pop()
            waiting += [to for char, to in state.items() if char != _FINAL]
            if pieces.MARK in state:
                state[" "] = state[pieces.MARK]

    def _merged(self, chars: str) -> list[str]:
        """Merging by rank: of all neighbours whose join is a piece the best scored one merges, the first of equals, until none is left."""
        parts, known = list(chars), self.scores.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = known(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _joins(self, left: str, right: str) -> bool:
        """Whether ``right`` after ``left`` costs nothing."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return found

    def _byte_pair_path(self, chars: str) -> list[int]:
        """Output labels of the one path of finite cost that reads all of ``chars``."""
        chars = chars.replace(" ", pieces.MARK)
        n, root, joins = len(chars), self.root, self._joins
        start_of, label_of = [-1] * (n + 1), [None] * (n + 1)
        for start in range(n):
            before = chars[start_of[start] : start] if start else ""
            state, at = root, start
            while at < n and (state := state.get(chars[at])) is not None:
                at += 1
                if _FINAL in state and start_of[at] < 0 and (not start or joins(before, chars[start:at])):
                    start_of[at], label_of[at] = start, state[_FINAL][0]
            if start_of[start + 1] < 0 and chars[start] not in self.scores and (not start or joins(before, chars[start])):
                start_of[start + 1] = start
        out, at = [], n
        while at:
            if start_of[at] < 0:
                raise ValueError("no path: the pieces are not a byte-pair vocabulary")
            if label_of[at] is None:
                out += [self.byte_ids[b] for b in reversed(chars[start_of[at]].encode("utf-8", "surrogatepass"))]
            else:
                out.append(label_of[at])
            at = start_of[at]
        return out[::-1]

    def _unigram_path(self, chars: str) -> list[int]:
        """Output labels of the cheapest path that reads all of ``chars`` and ends at the start state."""
        n, root = len(chars), self.root
        cost, back = [0.0] + [np.inf] * n, [None] * (n + 1)
        for start in range(n):
            base, state, at = cost[start], root, start
            while at < n and (state := state.get(chars[at])) is not None:
                at += 1
                if _FINAL in state:
                    label, weight = state[_FINAL]
                    if base + weight < cost[at]:
                        cost[at], back[at] = base + weight, (start, label)
            one = root.get(chars[start])
            if (one is None or _FINAL not in one) and base + self.fallback_cost < cost[start + 1]:
                cost[start + 1], back[start + 1] = base + self.fallback_cost, (start, None)
        out, at = [], n
        while at:
            start, label = back[at]
            if label is None:
                char = pieces.MARK if chars[start] == " " else chars[start]
                out += [self.byte_ids[b] for b in reversed(char.encode("utf-8", "surrogatepass"))]
            else:
                out.append(label)
            at = start
        return out[::-1]


@lru_cache(maxsize=2)
def compiled(path: str, kind: str = "bpe") -> Transducer:
    return Transducer(pieces.load(path), kind)


class Encoder:
    """Ids of whole texts; paths of units are found once and kept."""

    def __init__(self, path: str, kind: str = "bpe"):
        self.store = IdStore(lambda found: joined([compiled(path, kind).shortest_path(u) for u in found]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after another, and each text's number of ids."""
        found, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = pieces.units(pieces.normalise(text))
            counts[i] = len(own)
            found += own
        return self.store.ids(found, counts)


@lru_cache(maxsize=2)
def _piece_bytes(path: str) -> list[bytes]:
    vocabulary = pieces.load(path)
    out = [name.replace(pieces.MARK, " ").encode("utf-8", "surrogatepass") for name in vocabulary.names]
    for byte, label in enumerate(vocabulary.byte_ids):
        out[label] = bytes([byte])
    return out


def decode_ids(ids: list[int], path: str) -> str:
    """The text of ``ids``: pieces and bytes joined, marks as spaces, the dummy space taken off. Bytes that are no UTF-8 become U+FFFD; control ids say nothing."""
    table = _piece_bytes(path)
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """(id, ids) by a model of ``kind`` bpe or unigram: piece ids of every row's whole text, of any length.

    Null and empty texts have no ids; repeated rows and ties get equal ids; an empty table gives no rows; other
    columns are ignored. A model with a normaliser of its own raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = cache_for(("wfst", path, kind), lambda: Encoder(path, kind))
        for part, texts in text_chunks(batches, "_text"):
            ids, counts = coder.encode(texts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["_id", "ids"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every row's ids; null ids give a null text, no ids the empty one. One row a row, repeated ones too; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids.as_py() is None else decode_ids(ids.values.to_pylist(), path) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    source = coded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)


def digest(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_pieces, ids_crc32, text_sha256): digests of every row's ids (little-endian, 32 bits) and of the text that they decode to.

    Null ids count as none. One row a row, repeated ones too; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                ids = np.asarray(value.values if value.is_valid else [], "<i4")
                text = decode_ids(ids.tolist(), path)
                rows.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_id", "n_pieces", "ids_crc32", "text_sha256"])

    source = coded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, text_sha256 string").withColumnRenamed("_id", id_col)
