"""The vocabulary of a SentencePiece model file, and its texts' units.

As a unigram model a segmentation's score is the sum of its pieces' scores, characters that no
piece covers become their UTF-8 bytes' pieces at the lowest score less 10, and of equal scores the path whose
last piece is longer wins, decided from left to right. Scores add up in doubles, so this equals the `Unigram`
model of the public ``tokenizers`` library. As a byte-pair model, scores rank the merges, and the result equals
SentencePiece's for a file of that type.

No piece has a space mark after another character (checked on loading). A text therefore falls apart at every
space that follows a non-space, and its units can be encoded one by one and kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

MARK, PENALTY = "▁", 10.0
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Vocabulary:
    scores: dict[str, tuple[int, float]]  # piece -> (id, score)
    names: list[str]  # what each id stands for; '' for control pieces
    byte_ids: list[int]
    unknown_score: float


def model_path() -> str:
    """Where the installed model file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _check_normaliser(given: Callable[[str], str]) -> None:
    """Refuse a model whose normaliser does anything but mark spaces and put one before the text, by any character of the basic plane and by white space in all places."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    odd = ["", " ", "  a  b ", "a  ", "\ta\n b", "e\u0301", "\ufb01n", "\u1100\u1161", "\U0001f642 x"]
    for text in [*("".join(chars[i : i + 64]) for i in range(0, len(chars), 64)), *odd]:
        if given(text) != normalise(text):
            raise ValueError("the model has a normaliser of its own, which is not compiled here")


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    _check_normaliser(model.normalize)
    scores, names, byte_ids = {}, [], [-1] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        names.append("" if special else piece)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not special:
            scores[piece] = (i, model.get_score(i))
    if min(byte_ids) < 0:
        raise ValueError("the model has no piece for some byte")
    if crossing := next((p for p in scores if MARK in p.lstrip(MARK)), None):
        raise ValueError(f"units would not be independent: piece {crossing!r} has a space mark after another character")
    return Vocabulary(scores, names, byte_ids, min(s for _, s in scores.values()) - PENALTY)


def normalise(text: str) -> str:
    """The text behind one dummy space, spaces as marks; '' stays ''."""
    return MARK + text.replace(" ", MARK) if text else ""


def units(normal: str) -> list[str]:
    return _UNIT.findall(normal)
