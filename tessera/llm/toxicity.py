"""Toxicity: averaged subword-bag embeddings into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams and of the whole word, so a
misspelt word shares most of its vector with the words it resembles. A text's vector is the mean over all its
words, however many, and goes through the softmax: how dense toxic words are counts, in a text of any length.
Runs of more than 64 word characters are read as words of 64 characters and a rest.

Embeddings and softmax are fitted together by accelerated proximal gradient steps over the whole sample. N-grams
enter on the scale of their spread between texts; a group penalty on each embedding sets those to zero that teach
nothing, since plain averages would let the words that a single text has learn that text by heart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import labelled_sample, text_chunks
from ._words import WordCache, cache_for, char_ngrams

BITS, LOW, HIGH, DIM = 18, 3, 5, 16
#: An n-gram that fewer training texts have gets no embedding.
LEAST_TEXTS = 5
#: The group penalty on an embedding, the ridge penalty, and how many times the group penalty an n-gram's first gradient must reach.
GROUP, RIDGE, SCREEN = 0.012, 0.01, 2.0
#: The share of the loss that falls to label 1, however rare it is.
TOXIC_SHARE = 0.75
STEPS = 150
#: Bounds of the training sample: labelled texts per class, and characters of a text that are read (a slice, chosen by a hash, of a longer one).
TEXTS_PER_CLASS, MAX_TRAIN_CHARS = 2_000, 20_000
_WORD = re.compile(r"\w{1,64}")


def _words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = _WORD.findall(text.lower())
        counts[i] = len(own)
        words += own
    return words, counts


@dataclass
class SubwordModel:
    buckets: np.ndarray  # sorted ids of the n-grams that have an embedding
    embeddings: np.ndarray  # (buckets, DIM)
    softmax: np.ndarray  # (DIM, 2)
    bias: np.ndarray  # (2,)
    version: str = ""
    #: Whether both classes were learnt from; if not, the score is a constant.
    trained: bool = True

    def word_margins(self, words: list[str]) -> np.ndarray:
        """How far each word's vector speaks for label 1 over label 0."""
        if not words:
            return np.zeros(0)
        if not hasattr(self, "_margins"):
            self._margins = np.zeros(1 << BITS)
            self._margins[self.buckets] = np.einsum("bd,d->b", self.embeddings, self.softmax[:, 1] - self.softmax[:, 0])
        ids, counts = char_ngrams(words, LOW, HIGH, BITS)
        return np.add.reduceat(self._margins[ids], np.cumsum(counts) - counts) / counts

    def score(self, texts: list[str], cache: WordCache) -> np.ndarray:
        words, counts = _words(texts)
        total = np.zeros(len(texts))
        if words:
            rows, table = cache.lookup(words)
            total = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=table[rows], minlength=len(texts))
        margin = total / np.maximum(1, counts) + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _averages(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the n-grams and the share of each one's embedding in the text's vector."""
    vocabulary: dict[str, int] = {}
    bags = []
    for text in texts:
        words, uses = np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(text.lower())], return_counts=True)
        bags.append((words.astype(np.int32), (uses / max(1, uses.sum())).astype(np.float32)))
    ids, sizes = char_ngrams(list(vocabulary), LOW, HIGH, BITS)
    del vocabulary
    ends = np.cumsum(sizes)
    for words, uses in bags:
        n = sizes[words]
        places = np.repeat(ends[words] - np.cumsum(n), n) + np.arange(int(n.sum()))
        own, back = np.unique(ids[places], return_inverse=True)
        yield own.astype(np.int32), np.bincount(back, weights=np.repeat(uses / n, n), minlength=len(own)).astype(np.float32)


def train_subwords(rows: list[tuple[str, int]], group: float = GROUP, ridge: float = RIDGE, steps: int = STEPS, toxic_share: float = TOXIC_SHARE, seed: int = 5) -> SubwordModel:
    """Fit on (text, label) rows. With one class or none, the score is constant: that class, or 0.5."""
    labels = {y for _, y in rows}
    softmax = np.random.default_rng(seed).normal(size=(DIM, 2))
    if len(labels) < 2:
        bias = 0.0 if not labels else 4.0 if labels == {1} else -4.0
        return SubwordModel(np.zeros(0, np.int64), np.zeros((0, DIM)), softmax, np.array([0.0, bias]), f"constant-{bias}", False)
    n, truth = len(rows), np.array([y for _, y in rows], float)
    share = np.where(truth == 1, toxic_share / truth.sum(), (1 - toxic_share) / (n - truth.sum()))
    bags = []  # eight bytes an n-gram of a text; what the sums over all texts leave out is let go below
    often, square, first = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS), np.zeros(1 << BITS)
    for own, weight in _averages([t for t, _ in rows]):
        i = len(bags)
        often[own] += 1
        square[own] += weight.astype(float) ** 2
        first[own] += weight * ((toxic_share - truth[i]) * share[i])
        bags.append((own, weight))
    spread = np.sqrt(square / n)
    kept = np.flatnonzero((often >= min(LEAST_TEXTS, (n + 9) // 10)) & (np.abs(first) > SCREEN * group * spread))
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    for i, (own, weight) in enumerate(bags):
        live = number[own] >= 0
        bags[i] = (number[own[live]], weight[live] / spread[own[live]])
    owner = np.repeat(np.arange(n), [len(own) for own, _ in bags])
    gram, weight = (np.concatenate(part) for part in zip(*bags, strict=True))
    del bags

    def averaged(by_gram: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=weight * by_gram[gram], minlength=n)

    def gathered(by_text: np.ndarray) -> np.ndarray:
        return np.bincount(gram, weights=weight * by_text[owner], minlength=len(kept))

    probe, curve = np.ones(len(kept)), 1.0  # the loss's largest curvature, by power iteration
    for _ in range(12):
        probe = gathered(averaged(probe) * share)
        curve = max(1e-12, float(np.sqrt((probe**2).sum())))
        probe = probe / curve
    curve = 0.3 * curve + ridge
    slope = softmax[:, 1] - softmax[:, 0]
    slope = slope / np.sqrt((slope**2).sum())
    here, bias, pace = np.zeros((len(kept), DIM)), 0.0, 1.0
    ahead, ahead_bias = here, bias
    for _ in range(steps):
        margin = averaged(np.einsum("bd,d->b", ahead, slope)) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - truth) * share
        pull = gathered(error)
        new = ahead - (pull[:, None] * slope + ridge * ahead) / curve
        size = np.sqrt((new**2).sum(axis=1, keepdims=True))
        new = new * np.maximum(0, 1 - group / curve / np.maximum(size, 1e-300))
        turn = np.einsum("b,bd->d", pull, ahead)
        slope = slope - turn / curve / max(1.0, float((ahead**2).sum()))
        slope = slope / np.sqrt((slope**2).sum())
        new_bias = ahead_bias - 2 * error.sum()
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, ahead_bias = new + (pace - 1) / faster * (new - here), new_bias + (pace - 1) / faster * (new_bias - bias)
        here, bias, pace = new, new_bias, faster
    has = np.flatnonzero((here**2).sum(axis=1) > 0)
    embeddings = here[has] / spread[kept[has]][:, None]
    model = SubwordModel(kept[has], embeddings, np.stack([-slope / 2, slope / 2], axis=1), np.array([-bias / 2, bias / 2]))
    model.version = f"{hash(embeddings.tobytes())}-{bias}"
    return model


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, label: str = "toxic", per_class: int = TEXTS_PER_CLASS) -> SubwordModel:
    """Learn from a bounded sample of labelled rows whose ids are ``eligible`` (a condition on doc_id)."""
    return train_subwords([(t, y) for t, y, _ in labelled_sample(docs, labels, label, eligible, per_class, MAX_TRAIN_CHARS)])


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` rows as id, score (0 to 1; higher: label 1 likelier), predicted (1 from 0.5 on).

    Null, empty and wordless texts have the zero vector and get the score of the bias. Texts of any length are
    scored whole. Repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: at most 2**BITS x DIM doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = cache_for(("subwords", model.version), lambda: WordCache(model.word_margins))
        for part, texts in text_chunks(batches, "_text"):
            got = model.score(texts, cache)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("_id", id_col)


def keep(docs: DataFrame, model: SubwordModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not call toxic (label 1). One pass, no shuffle.

    Null and empty texts get the score of the bias; repeated rows stay or go together; an empty table gives no
    rows. A model that has not seen both classes drops nothing.
    """
    if not model.trained:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = cache_for(("subwords", model.version), lambda: WordCache(model.word_margins))
        for part, texts in text_chunks(batches, text_col):
            got = model.score(texts, cache)
            yield part.filter(pa.array(got < 0.5))

    return docs.mapInArrow(run, docs.schema)
