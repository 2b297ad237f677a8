"""A public piece vocabulary as unigram pieces with scores, its Aho-Corasick automaton, and the
splitting of texts at marks that no piece crosses."""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import sentencepiece

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def load_pieces(path: str = DEFAULT_MODEL) -> list[tuple[str, float]]:
    """The ordinary pieces and their scores; control, unknown and byte pieces match no text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


def automaton(pieces: list[str]) -> ahocorasick.Automaton:
    """Its matches carry the piece's index; those that end at one place come longest first."""
    out = ahocorasick.Automaton()
    for i, piece in enumerate(pieces):
        out.add_word(piece, i)
    out.make_automaton()
    return out


def divisible(pieces: list[str]) -> bool:
    """Whether no piece has a mark after another character, so that each run of marks starts a
    part of the text whose best segmentation is its own."""
    return all(MARK not in piece.lstrip(MARK) for piece in pieces)


def units(text: str) -> list[str]:
    """The parts of a text at its spaces, a mark before each word and for each space."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    return _UNITS.findall(MARK + text.replace(" ", MARK))


class Memo(dict):
    """Results by unit, forgotten when there are `limit`; then long units aren't kept either."""

    def __init__(self, compute: Callable, limit: int | None = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, unit: str):
        value = self.compute(unit)
        if self.limit is None:
            self[unit] = value
        elif len(unit) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = value
        return value

