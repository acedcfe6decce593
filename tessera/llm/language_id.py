"""Language identification with a linear-chain conditional random field over words.

Each word's emission scores come from hashed character n-grams (those that touch a word's edge are its
affixes), the whole word, and membership in each language's lexicon of frequent words. Transitions are learnt
on code-switched sequences, made from runs of words of training texts in different languages. A text's
words get their posterior language shares by forward-backward over the whole text; the text's language is the
one with the largest mean share. Runs of more than 64 letters are read as words of 64 letters and a rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import checkpoint, smallest_by_hash, text_chunks, text_slice
from ._words import WordCache, cache_for, char_ngrams

UNDETERMINED = "und"
BITS, LOW, HIGH = 17, 1, 4
#: Bounds of the training sample: texts per language, characters of a text that are read (a slice, chosen by a hash, of a longer one), languages.
TEXTS_PER_LANGUAGE, MAX_TRAIN_CHARS, MAX_LANGUAGES = 400, 20_000, 64
LEXICON = 500
#: Words per block of the forward-backward scan.
BLOCK = 32
_WORD = re.compile(r"[^\W\d_]{1,64}")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class CrfModel:
    languages: list[str]
    features: np.ndarray  # (2**BITS, languages)
    lexicon: dict[str, int]  # word -> bit set of languages
    lexicon_weights: np.ndarray  # (lexicons, languages)
    transitions: np.ndarray  # (from, to), log scale
    start: np.ndarray
    version: str = ""

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        ids, counts = char_ngrams(words, LOW, HIGH, BITS)
        scores = np.add.reduceat(self.features[ids], np.cumsum(counts) - counts, axis=0, dtype=float) / np.sqrt(counts)[:, None]
        for i, word in enumerate(words):
            bits = self.lexicon.get(word, 0)
            k = 0
            while bits:
                if bits & 1:
                    scores[i] += self.lexicon_weights[k]
                bits >>= 1
                k += 1
        return scores


def _scan(model: CrfModel, scores: np.ndarray, counts: np.ndarray, by_word: bool = False) -> np.ndarray:
    """Sum of each text's posterior language shares, or those of each word; ``scores`` are the emissions of all words, ``counts`` the words of each text (none 0).

    Exact forward-backward. Texts are cut into blocks of BLOCK words; the blocks' transfer matrices are
    multiplied in parallel, a scan over each text's blocks carries the messages between them, and a second
    pass inside the blocks gives the shares. Short blocks are padded with steps that change nothing.
    """
    n_lang = len(model.languages)
    step = np.exp(model.transitions - model.transitions.max())
    blocks = -(-counts // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    first_word = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(scores)) - first_word[owner]
    row, col = first_block[owner] + inside // BLOCK, inside % BLOCK
    total = int(blocks.sum())
    emit = np.ones((BLOCK, total, n_lang))
    emit[col, row] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros((BLOCK, total), bool)
    real[col, row] = True
    opens = first_block  # each text's first block: its first word has no word before it
    begin = np.exp(model.start - model.start.max())

    def forward(state: np.ndarray, t: int) -> np.ndarray:
        """state: (blocks, k, languages) messages before word t."""
        moved = np.matmul(state, step)
        if t == 0:
            moved[opens] = state[opens]
        moved *= emit[t][:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        return np.where(real[t][:, None, None], moved, state)

    transfer = np.broadcast_to(np.eye(n_lang), (total, n_lang, n_lang)).copy()
    for t in range(BLOCK):
        transfer = forward(transfer, t)
    enter, leave = np.empty((total, n_lang)), np.empty((total, n_lang))
    order = np.argsort(-blocks, kind="stable")
    live = blocks[order]
    alpha = np.broadcast_to(begin, (len(counts), n_lang)).copy()
    beta = np.ones((len(counts), n_lang))
    for k in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(-live, -k, side="left"))
        who = order[:n]
        at = first_block[who] + k
        enter[at] = alpha[who]
        alpha[who] = np.einsum("bi,bij->bj", alpha[who], transfer[at])
        alpha[who] /= alpha[who].sum(axis=1, keepdims=True)
        back = first_block[who] + blocks[who] - 1 - k
        leave[back] = beta[who]
        beta[who] = np.einsum("bij,bj->bi", transfer[back], beta[who])
        beta[who] /= beta[who].sum(axis=1, keepdims=True)
    messages = np.empty((BLOCK, total, n_lang))
    state = enter[:, None, :]
    for t in range(BLOCK):
        state = forward(state, t)
        messages[t] = state[:, 0, :]
    shares = np.zeros((total, n_lang))
    beta = leave
    for t in range(BLOCK - 1, -1, -1):
        both = messages[t] * beta
        both /= both.sum(axis=1, keepdims=True)
        shares += np.where(real[t][:, None], both, 0)
        messages[t] = both
        moved = np.matmul(beta * emit[t], step.T)
        moved /= moved.max(axis=1, keepdims=True)
        beta = np.where(real[t][:, None], moved, beta)
    return messages[col, row] if by_word else np.add.reduceat(shares, first_block, axis=0)


def _code_switched(texts: list[list[str]], langs: list[int], n: int, rng) -> tuple[list[list[str]], list[list[int]]]:
    """``n`` sequences of one to three runs of 6 to 20 words, each run from another text."""
    by_lang: dict[int, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    present = sorted(by_lang)
    sequences, labels = [], []
    for _ in range(n):
        words, marks = [], []
        for lang in rng.choice(present, size=int(rng.integers(1, 4))):
            own = texts[by_lang[lang][int(rng.integers(len(by_lang[lang])))]]
            size = int(rng.integers(6, 21))
            at = int(rng.integers(max(1, len(own) - size)))
            words += own[at : at + size]
            marks += [int(lang)] * len(own[at : at + size])
        sequences.append(words), labels.append(marks)
    return sequences, labels


def _gradients(emit_scores: np.ndarray, marks: np.ndarray, mask: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Gradients of the negative log-likelihood of padded sequences: by emission, transition and start."""
    n, length, k = emit_scores.shape
    e = np.exp(emit_scores - emit_scores.max(axis=2, keepdims=True))
    step = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = np.exp(start) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = np.einsum("bi,ij->bj", alpha[:, t - 1], step) * e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], a / a.sum(axis=1, keepdims=True), alpha[:, t - 1])
    g_step = np.zeros_like(step)
    for t in range(length - 2, -1, -1):
        ahead = e[:, t + 1] * beta[:, t + 1]
        b = np.einsum("ij,bj->bi", step, ahead)
        pair = alpha[:, t, :, None] * step * ahead[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        on = mask[:, t + 1]
        g_step += pair[on].sum(axis=0)
        np.subtract.at(g_step, (marks[on, t], marks[on, t + 1]), 1.0)
        beta[:, t] = np.where(on[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    truth = np.eye(k)[marks]
    return np.where(mask[:, :, None], post - truth, 0), g_step, (post[:, 0] - truth[:, 0]).sum(axis=0)


def train_crf(rows: list[tuple[str, str]], sequences: int = 3_000, epochs: int = 4, batch: int = 100, rate: float = 0.3, seed: int = 7) -> CrfModel:
    """Fit the field on (text, language) rows; deterministic for a given list."""
    languages = sorted({lang for _, lang in rows})
    k, rng = len(languages), np.random.default_rng(seed)
    texts = [words_of(text) for text, _ in rows]
    langs = [languages.index(lang) for _, lang in rows]
    keep = [i for i, words in enumerate(texts) if words]
    texts, langs = [texts[i] for i in keep], [langs[i] for i in keep]
    tallies = [Counter() for _ in languages]
    for words, lang in zip(texts, langs, strict=True):
        tallies[lang].update(words)
    lexicon: dict[str, int] = {}
    for lang, tally in enumerate(tallies):
        for word, _ in sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = lexicon.get(word, 0) | 1 << lang
    model = CrfModel(languages, np.zeros((1 << BITS, k)), lexicon, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not texts:
        model.version = f"constant-{languages}"
        return model
    seqs, marks = _code_switched(texts, langs, sequences, rng)
    vocabulary: dict[str, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in s] for s in seqs]
    ids, counts = char_ngrams(list(vocabulary), LOW, HIGH, BITS)
    ends = np.cumsum(counts)
    size = (k + 7) // 8
    bits = np.frombuffer(b"".join(lexicon.get(w, 0).to_bytes(size, "little") for w in vocabulary), np.uint8).reshape(-1, size)
    in_lexicon = np.unpackbits(bits, axis=1, count=k, bitorder="little").astype(float)
    squares = [np.full_like(x, 1e-6) for x in (model.features, model.lexicon_weights, model.transitions, model.start)]
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for at in range(0, len(seqs), batch):
            chosen = [i for i in order[at : at + batch] if coded[i]]
            if not chosen:
                continue
            longest = max(len(coded[i]) for i in chosen)
            word, mark, mask = (np.zeros((len(chosen), longest), t) for t in (np.int64, np.int64, bool))
            for r, i in enumerate(chosen):
                n = len(coded[i])
                word[r, :n], mark[r, :n], mask[r, :n] = coded[i], marks[i], True
            used, back = np.unique(word[mask], return_inverse=True)
            spans = np.concatenate([np.arange(ends[u] - counts[u], ends[u]) for u in used])
            sizes = counts[used]
            feature = ids[spans]
            scores = np.add.reduceat(model.features[feature], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None] + np.einsum("wl,lk->wk", in_lexicon[used], model.lexicon_weights)
            full = np.zeros((*word.shape, k))
            full[mask] = scores[back]
            g_emit, g_step, g_start = _gradients(full, mark, mask, model.transitions, model.start)
            by_word = np.stack([np.bincount(back, weights=g_emit[mask][:, j], minlength=len(used)) for j in range(k)], axis=1)
            spread = np.repeat(by_word / np.sqrt(sizes)[:, None], sizes, axis=0)
            g_features = np.stack([np.bincount(feature, weights=spread[:, j], minlength=1 << BITS) for j in range(k)], axis=1)
            g_lexicon = np.einsum("wl,wk->lk", in_lexicon[used], by_word)
            for value, square, g in zip((model.features, model.lexicon_weights, model.transitions, model.start), squares, (g_features, g_lexicon, g_step, g_start), strict=True):
                g = g / len(chosen) + 1e-7 * value
                square += g * g
                value -= rate * g / np.sqrt(square)
    model.features = model.features.astype(np.float32)
    model.version = f"{hash(model.features.tobytes())}-{hash(model.transitions.tobytes())}"
    return model


def predict_texts(model: CrfModel, texts: list[str], cache: WordCache | None = None) -> tuple[list[str], np.ndarray]:
    """Language and mean posterior share of each whole text."""
    cache = cache or WordCache(model.emissions)
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = words_of(text)
        if own and not any(map(str.isalpha, own)) and not any(c.isalpha() for w in own for c in w):
            own = []  # numerals that are no letters
        counts[i] = len(own)
        words += own
    out, share = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    has = np.flatnonzero(counts)
    if len(has) and model.languages:
        rows, values = cache.lookup(words)
        mean = _scan(model, values[rows], counts[has]) / counts[has, None]
        best = mean.argmax(axis=1)
        share[has] = np.clip(mean[np.arange(len(has)), best], 0, 1)
        for i, lang in zip(has.tolist(), best.tolist(), strict=True):
            out[i] = model.languages[lang]
    return out, share


def training_rows(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE, max_chars: int = MAX_TRAIN_CHARS, max_languages: int = MAX_LANGUAGES) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, language) rows of each language, chosen by a hash of the id among ``eligible`` rows with a text.

    Of a text over ``max_chars`` characters a slice is learnt from (predictions read it whole). With more than
    ``max_languages`` languages the most frequent ones are learnt. An empty table gives an empty list.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0) & eligible)
    usable = usable.select(F.col(id_col).alias("_i"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"))
    ids = checkpoint(usable.select(F.col("_i").alias("_id"), F.col("_l").alias("_key")))
    chosen = F.broadcast(smallest_by_hash(ids, per_language, max_languages))  # at most max_languages x per_language rows
    found = usable.join(chosen, (F.col("_i") == F.col("_id")) & (F.col("_l") == F.col("_key"))).select("_i", "_l", text_slice("_t", "_i", max_chars).alias("_t"))
    rows = found.groupBy("_i", "_l").agg(F.min("_t").alias("_t")).collect()
    return [(r["_t"], r["_l"]) for r in sorted(rows, key=lambda r: (r["_l"], r["_i"]))]


def identify(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.

    Texts that are null, empty or without a letter are ``und`` with score 0. Texts of any length are read whole.
    Ties between languages go to the first in sorted order. Repeated rows get equal results; an empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS x MAX_LANGUAGES floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = cache_for(("crf", model.version), lambda: WordCache(model.emissions))
        for part, texts in text_chunks(batches, "_text"):
            langs, scores = predict_texts(model, texts, cache)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], names=["_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def label_words(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of each row of ``docs``: id, position (from 0), word (lower-cased), lang, share.

    The labels of code-switched text: each word's language with the largest posterior by forward-backward over the
    whole text, and that posterior; ties go to the first in sorted order. Texts that are null, empty or without a
    letter have no word, and so has every text of a model without languages. Repeated rows are labelled each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS x MAX_LANGUAGES floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        cache = cache_for(("crf", model.version), lambda: WordCache(model.emissions))
        for part, texts in text_chunks(batches, "_text"):
            words, counts = [], np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                own = words_of(text)
                counts[i] = len(own)
                words += own
            if not words or not len(names):
                continue
            rows, values = cache.lookup(words)
            shares = _scan(model, values[rows], counts[counts > 0], by_word=True)
            best = shares.argmax(axis=1)
            owner = np.repeat(np.arange(len(texts)), counts)
            position = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [part.column(0).take(pa.array(owner)), pa.array(position), pa.array(words), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(shares[np.arange(len(best)), best], 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "position", "word", "lang", "share"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, position long, word string, lang string, share double").withColumnRenamed("_id", id_col)
