"""Statistics of one document's text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import math
import operator

import numpy as np

from assayloom.llm.common import hash_words, rolling

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_DROP_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACES = b" \t\n\x0b\x0c\r"

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_lower", "n_digits", "n_bang", "n_bar", "n_stop", "n_lines", "n_caps_words", "n_distinct", "n_plain", "n_echo", "n_symbol_words"]


def repeat_words(text: bytes, words: list[bytes], k: int = 8) -> int:
    """Words that lie in a ``k``-word window found at least twice, the first time included; windows compare as texts."""
    if len(words) <= k:
        return 0
    w = rolling(hash_words(text), k)
    s = np.sort(w)
    if not (s[1:] == s[:-1]).any():
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    seen: dict[tuple, int] = {}
    for i in at:
        seen[t] = seen.get(t := tuple(words[i : i + k]), 0) + 1
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + k])] > 1:
            cover[i] += 1
            cover[i + k] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: bytes | None) -> list[int]:
    """The numbers of ``NAMES`` for a whole text in UTF-8; all 0 for null."""
    text = text or b""
    words = text.split()
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip(_SPACES)]
    count = lambda chars: len(text) - len(text.translate(None, chars))
    chars = len(text.translate(None, _DROP_CONTINUATION))
    symbols, letters = count(SYMBOLS), b"".join(words)
    caps = sum(map(bytes.isupper, words))
    symbol_words = sum(1 for w in words if w[-1] in SYMBOLS) if symbols else 0
    return [
        len(words),
        len(letters.translate(None, _DROP_CONTINUATION)),
        symbols,
        len(full) - len(set(full)),
        repeat_words(text, words),
        chars,
        count(_UPPER),
        count(_LOWER),
        count(_DIGITS),
        text.count(b"!"),
        text.count(b"|"),
        text.count(b"."),
        len(full),
        caps,
        len(set(words)),
        sum(map(bytes.isalpha, words)),
        sum(map(operator.eq, words, words[1:])),
        symbol_words,
    ]


#: Ratios the anomaly forest and the classifier look at, in this order.
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "caps_words", "digits", "bangs", "bars", "stops", "distinct", "plain", "line_words", "symbol_words", "echoes"]


def ratios(m: np.ndarray) -> np.ndarray:
    """Rows of ``measure`` to rows of ``FEATURES``: size-free and of even spread."""
    c = dict(zip(NAMES, m.astype(float).T, strict=True))
    w, ch, ln = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    return np.column_stack([
        np.log1p(c["n_words"]),
        np.minimum(c["word_chars"] / w, 40),
        root(c["n_symbols"] / ch),
        root(c["n_dup_lines"] / ln),
        root(c["n_repeat_words"] / w),
        root(c["n_upper"] / ch),
        root(c["n_caps_words"] / w),
        root(c["n_digits"] / ch),
        root(c["n_bang"] / ch),
        root(c["n_bar"] / ch),
        root(c["n_stop"] / w),
        c["n_distinct"] / w * np.log1p(w) / math.log(1000),
        c["n_plain"] / w,
        np.log1p(w / ln),
        root(c["n_symbol_words"] / w),
        root(c["n_echo"] / w),
    ])
