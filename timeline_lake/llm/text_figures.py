"""Figures about one text. Words are runs of anything but the six ASCII white-space characters, as ``bytes.split`` has it."""

from __future__ import annotations

import numpy as np

# The white space between words, and the symbols that are counted.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    codes: dict[bytes, int] = {}
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))


def repeated_words(codes: np.ndarray) -> int:
    """How many words lie in a window of three words that occurs at least twice."""
    if len(codes) < 4:
        return 0
    n = int(codes.max()) + 1
    if n < 1 << 20:
        windows = (codes[:-2] * n + codes[1:-1]) * n + codes[2:]
    else:
        _, pairs = np.unique(codes[:-1] * n + codes[1:], return_inverse=True)
        windows = pairs[:-1] * n + codes[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = np.append(False, ordered[1:] == ordered[:-1])
    twice = order[same | np.append(same[1:], False)]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines)), len(lines)


def base_figures(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    codes = word_codes(data.split())
    return (
        len(codes),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text)[0],
        repeated_words(codes),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words
