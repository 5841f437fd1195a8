"""Counts over whole texts that several operators use."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

from .arrays import COEF3, WordHashes, hashed, mix, words

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WIDE = re.compile("[^\0-\x7f]+")
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def case_counts(text: str) -> tuple[int, int]:
    """(upper-case characters, letters) of a whole text: ASCII by bytes, other characters one by one."""
    raw = text.encode("utf-8", "surrogatepass")
    wide = "" if len(raw) == len(text) else "".join(WIDE.findall(text))
    return (len(raw.translate(None, NOT_UPPER)) + sum(map(str.isupper, wide)), len(raw.translate(None, NOT_LETTER)) + sum(map(str.isalpha, wide)))


def repeated_words(x: np.ndarray) -> int:
    """Words inside a 3-word window whose words occur at another place of the text too, in order."""
    n = len(x) - 2
    if n < 2:
        return 0
    tri = mix(x[:n] * COEF3[0] + x[1:n + 1] * COEF3[1] + x[2:] * COEF3[2])
    order = np.argsort(tri, kind="stable")
    same = tri[order][1:] == tri[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, dtype=bool)
    for j in range(3):
        covered[j:n + j] |= twice
    return int(covered.sum())


def base_counts(text: str | None, cache: WordHashes) -> Counts:
    """Base counts of a text; all zero for null and empty texts."""
    if not text:
        return Counts(0, 0, 0, 0, 0)
    x = hashed(words(text), cache)
    lines = [l for l in text.split("\n") if l.strip(SPACES)]
    return Counts(len(x), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(x))


def base_failed(c: Counts) -> bool:
    return c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words
