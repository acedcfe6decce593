"""Column builders for text: log masking, normalising, tokens, lexicon scores, slugs, chunks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a variable part of a log line, in the order of masking.
MASKS = (
    r"blk_-?\d+",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b",
    r"-?\b\d+(?:\.\d+)?\b",
)
NEGATIONS = ("not", "no", "never")


def mask_line(line: Column) -> Column:
    """A log line with its variable parts as <*> and white space collapsed."""
    for pattern in MASKS:
        line = F.regexp_replace(line, pattern, "<*>")
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case, link texts instead of links, no URLs, only letters, digits and underscores, single spaces."""
    text = F.regexp_replace(F.lower(text), r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def lexicon_score(tokens: Column, lexicon: Mapping[str, float], window: int = 3, alpha: float = 15.0) -> Column:
    """Sum of valences, each turned around within ``window`` tokens after a negation, squashed by t / sqrt(t*t + alpha)."""
    valence = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in (pair[0], float(pair[1]))])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("left"))

    def step(acc: Column, word: Column) -> Column:
        value = F.coalesce(F.element_at(valence, word), F.lit(0.0))
        negation = word.isin(*NEGATIONS)
        total = acc["total"] + F.when(negation, 0.0).when(acc["left"] > 0, -value).otherwise(value)
        left = F.when(negation, F.lit(window)).otherwise(F.greatest(acc["left"] - 1, F.lit(0)))
        return F.struct(total.alias("total"), left.alias("left"))

    return F.aggregate(tokens, start, step, lambda acc: acc["total"] / F.sqrt(acc["total"] * acc["total"] + F.lit(alpha)))


def word_chunks(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Array of word windows of ``size`` words that share ``overlap``; ends once the last word is covered."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    words, stride = F.filter(F.split(text, r"\s+"), lambda w: w != ""), size - overlap
    count = F.size(words)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((count - size) / F.lit(stride)).cast("int")) * stride, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))


def slug(text: Column) -> Column:
    """ASCII slug: accents of the Latin letters dropped, everything else but letters and digits as single underscores."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def hash_fraction(value: Column, seed: int) -> Column:
    """Value's place in [0, 1] by the first 8 hex digits of sha256('seed:value')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
