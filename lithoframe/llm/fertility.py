"""Quality rules on how a public vocabulary cuts a text: characters per token, byte-fallback share, token entropy.

Text that a vocabulary was made for takes few tokens per character, hardly any byte tokens, and a wide
spread of tokens. Each script has bands of its own; a text outside of any is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lithoframe.llm.common import WORD, Remembered, add_text_columns, per_process, portions

_WORDS = re.compile(WORD)
_SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string, kept boolean")

#: First code point of each range, and the script of its letters (fixed values of the Unicode blocks).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x1100, "cjk"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD800, "other"), (0xF900, "cjk"), (0xFB00, "other"),
    (0x20000, "cjk"), (0x32000, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_NAMES = sorted({b for _, b in SCRIPTS})
_OF_RANGE = np.array([_NAMES.index(b) for _, b in SCRIPTS])


@dataclass(frozen=True)
class Band:
    chars_per_token: tuple[float, float]
    byte_share: float       # at most
    entropy: float          # bits, at least


@dataclass(frozen=True)
class Settings:
    vocabulary: str | None = None   # a sentencepiece file with byte fallback; by default the installed piece_bpe_32k.model
    least_words: int = 50
    bands: tuple = (
        ("latin", Band((1.6, 12.0), 0.10, 5.2)), ("greek", Band((0.6, 8.0), 0.20, 3.0)),
        ("cyrillic", Band((0.8, 10.0), 0.20, 3.5)), ("hebrew", Band((0.5, 6.0), 0.30, 3.0)),
        ("arabic", Band((0.5, 6.0), 0.30, 3.0)), ("indic", Band((0.3, 6.0), 0.60, 3.0)),
        ("thai", Band((0.3, 6.0), 0.60, 3.0)), ("cjk", Band((0.3, 4.0), 0.75, 3.5)),
        ("other", Band((0.2, 12.0), 1.0, 2.5)))

    def path(self) -> str:
        import public_tokenizers

        return self.vocabulary or public_tokenizers.path("piece_bpe_32k.model")


class Pieces(Remembered):
    """Piece ids (16-bit) of words. White space is left to the words around it, so lines cost no byte tokens."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def encode_all(self, words: list[str]) -> Iterable[bytes]:
        return (np.array(ids, np.uint16).tobytes() for ids in self.model.encode(words, num_threads=1))


def script_of(text: str) -> str:
    """The script of most letters; latin if there are none."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = points[points >= 0xC0]
    counts = np.bincount(_OF_RANGE[np.searchsorted(_STARTS, odd, side="right") - 1], minlength=len(_NAMES))
    counts[_NAMES.index("latin")] += int((((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A)).sum())
    return _NAMES[int(counts.argmax())]


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.r_[count[at] > 1, False, False]
    return int((twice | np.r_[False, twice[:-1]] | np.r_[False, False, twice[:-2]]).sum())


def measures(text: str | None, words: list[str], pieces: Pieces, s: Settings) -> tuple:
    text, n, chars = text or "", len(words), sum(map(len, words))
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            again += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    failed = n < s.least_words or 100 * repeated > 50 * n
    ids = np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.uint16)
    per_token = byte = entropy = 0.0
    if len(ids):
        count = np.bincount(ids)
        per_token, byte = chars / len(ids), float(pieces.is_byte[ids].mean())
        share = count[count > 0] / len(ids)
        entropy = float(-(share * np.log2(share)).sum())
    script = script_of(text)
    band = dict(s.bands)[script]
    kept = (not failed and band.chars_per_token[0] <= per_token <= band.chars_per_token[1]
            and byte <= band.byte_share and entropy >= band.entropy)
    return (n, chars, sum(text.count(c) for c in SYMBOLS), again, repeated, failed, len(ids), per_token, byte,
            entropy, script, kept)


def judge(docs: DataFrame, text: str = "text", settings: Settings = Settings(), prefix: str = "") -> DataFrame:
    """docs with the counts, the vocabulary's measures and ``kept``, each from the whole text.

    A null text has no words, fails the base rules and is not kept. New names begin with ``prefix``; input columns of
    these names are replaced.
    """
    def batch(texts: list) -> pd.DataFrame:
        pieces, made = per_process(Pieces, settings.path()), []
        for part in portions(texts):
            split = [_WORDS.findall(t) if t else [] for t in part]
            pieces.learn(split)
            made += [measures(t, w, pieces, settings) for t, w in zip(part, split)]
        return pd.DataFrame(made, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return add_text_columns(docs, text, batch, SCHEMA, prefix)
