"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of word characters and runs of other visible characters. A text's features are hashed unigrams
and bigrams of lower-cased tokens, hashed n-grams (1 to 3) of token shapes, and back-references: n-grams whose
last token repeats the one 1 to 8 places before. Every feature's value is its count over the text's number of
tokens, so a score is a sparse dot product that does not depend on a text's length. Runs of more than 64
characters of a kind are read as tokens of 64 characters and a rest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import labelled_sample, text_chunks
from ._words import WordCache, cache_for, mix

BITS, BACK = 18, 8
#: Bounds of the training sample: labelled texts per class, and characters of a text that are read (a slice, chosen by a hash, of a longer one).
TEXTS_PER_CLASS, MAX_TRAIN_CHARS = 1_500, 20_000
_TOKEN = re.compile(r"\w{1,64}|[^\w\s]{1,64}")


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token
    if token.isdigit():
        return "9"
    if token.islower():
        return "x"
    if token.isupper():
        return "X" if len(token) == 1 else "XX"
    return "Xx" if token.istitle() else "mixed"


def token_hashes(tokens: list[str]) -> np.ndarray:
    """Two hashes a token: of its lower-cased form and of its shape."""
    hashes = [(xxhash.xxh64_intdigest(t.lower()), xxhash.xxh64_intdigest(_shape(t), 1)) for t in tokens]
    return np.array(hashes, np.uint64).reshape(-1, 2)


def feature_ids(words: np.ndarray, shapes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket ids, owning text) of each family of features."""

    def bucket(h: np.ndarray, family: int) -> np.ndarray:
        return (mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(family)) >> np.uint64(64 - BITS)).astype(np.int64)

    yield bucket(words, 1), owner
    two = owner[1:] == owner[:-1]
    three = two[1:] & two[:-1]
    yield bucket((mix(words[:-1]) + words[1:])[two], 2), owner[1:][two]
    yield bucket(shapes, 3), owner
    pair = mix(shapes[:-1]) + shapes[1:]
    yield bucket(pair[two], 4), owner[1:][two]
    yield bucket((mix(pair[:-1]) + shapes[2:])[three], 5), owner[2:][three]
    for back in range(1, BACK + 1):
        same = (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
        yield np.full(int(same.sum()), bucket(np.array([back], np.uint64), 6)[0]), owner[back:][same]


def _tokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    tokens, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = _TOKEN.findall(text)
        counts[i] = len(own)
        tokens += own
    return tokens, counts


@dataclass
class LogisticModel:
    weights: np.ndarray
    bias: float
    #: Whether both classes were learnt from; if not, the score is a constant.
    trained: bool = True

    def score(self, texts: list[str], cache: WordCache) -> np.ndarray:
        tokens, counts = _tokens(texts)
        logit = np.full(len(texts), self.bias)
        if tokens:
            rows, table = cache.lookup(tokens)
            owner = np.repeat(np.arange(len(texts)), counts)
            total = np.zeros(len(texts))
            for ids, whose in feature_ids(table[rows, 0], table[rows, 1], owner):
                total += np.bincount(whose, weights=self.weights[ids], minlength=len(texts))
            logit += total / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train_ftrl(rows: list[tuple[str, int]], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, seed: int = 11) -> LogisticModel:
    """Fit on (text, label) rows. With one class or none in the sample, the score is constant: that class, or 0.5."""
    labels = {y for _, y in rows}
    if len(labels) < 2:
        return LogisticModel(np.zeros(1 << BITS), 0.0 if not labels else 4.0 if labels == {1} else -4.0, False)
    cache, examples = WordCache(token_hashes, limit=1 << 62), []
    for text, y in rows:
        tokens, _ = _tokens([text])
        ids, values = np.zeros(0, np.int64), np.zeros(0)
        if tokens:
            at, table = cache.lookup(tokens)
            found = np.concatenate([i for i, _ in feature_ids(table[at, 0], table[at, 1], np.zeros(len(at), np.int64))])
            ids, values = np.unique(found, return_counts=True)
            values = values / len(tokens)
        examples.append((np.append(ids, 1 << BITS).astype(np.int32), np.append(values, 1.0).astype(np.float32), y))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(seed)

    def weights(z_, n_):
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((beta * 1e-2 + np.sqrt(n_)) / alpha + l2))

    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            ids, values, y = examples[e]
            w = weights(z[ids], n[ids])
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, float((w * values).sum())))))
            g = (p - y) * values
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weights(z, n)
    return LogisticModel(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, label: str = "quality", per_class: int = TEXTS_PER_CLASS) -> LogisticModel:
    """Learn from a bounded sample of labelled rows whose ids are ``eligible`` (a condition on doc_id)."""
    return train_ftrl([(t, y) for t, y, _ in labelled_sample(docs, labels, label, eligible, per_class, MAX_TRAIN_CHARS)])


def score(docs: DataFrame, model: LogisticModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` rows as id, score (0 to 1; higher: label 1 likelier), predicted (1 from 0.5 on).

    Null, empty and blank texts have no feature and get the score of the bias. Texts of any length are scored
    whole. Repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(("tokens", BITS), lambda: WordCache(token_hashes))
        for part, texts in text_chunks(batches, "_text"):
            got = shared.value.score(texts, cache)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("_id", id_col)


def keep(docs: DataFrame, model: LogisticModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not call of low quality (label 0). One pass, no shuffle.

    Null and empty texts get the score of the bias; repeated rows stay or go together; an empty table gives no
    rows. A model that has not seen both classes drops nothing.
    """
    if not model.trained:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = cache_for(("tokens", BITS), lambda: WordCache(token_hashes))
        for part, texts in text_chunks(batches, text_col):
            got = model.score(texts, cache)
            yield part.filter(pa.array(got >= 0.5))

    return docs.mapInArrow(run, docs.schema)
