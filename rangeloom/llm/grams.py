"""Hashed byte n-grams of whole texts, counted with NumPy."""

from __future__ import annotations

import numpy as np

#: ASCII characters that are no letters become a space; letters fall to lower case; other bytes stay.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], "uint8")
#: An odd multiplier that spreads n-grams over the table (Fibonacci hashing).
SPREAD = np.uint32(2654435769)


def gram_counts(text: str, orders: tuple[int, ...], bits: int, fold: bool) -> np.ndarray:
    """Counts of the text's byte n-grams in 2**bits cells. ``fold``: letters only, in lower case."""
    raw = np.frombuffer(f" {text} ".encode("utf-8", "replace"), "uint8")
    if fold:
        raw = LETTERS[raw]
    raw = raw.astype("uint32")
    cells, value = [], np.zeros(len(raw), "uint32")
    for n in range(1, max(orders) + 1):
        if len(raw) < n:
            break
        value = (value[: len(raw) - n + 1] << np.uint32(8)) ^ raw[n - 1 :]
        if n in orders:
            cells.append(((value + np.uint32(n)) * SPREAD) >> np.uint32(32 - bits))
    return np.bincount(np.concatenate(cells), minlength=1 << bits) if cells else np.zeros(1 << bits, "int64")


#: Shares that tell the shape of a text, each cut at these values into bins.
SHAPE_CUTS = (0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75)
SHAPES = ("word as the last one", "line seen before", "capitals among letters", "signs among characters", "digits among characters", "words of signs only", "words with signs inside or at the end", "short lines", "new words")
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.frombuffer(s, "uint8")) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_SIGN = ~(_UPPER | _LOWER | _DIGIT | (np.arange(256) >= 128) | np.isin(np.arange(256), np.frombuffer(b" \t\r\n.,", "uint8")))


def shape_terms(text: str) -> np.ndarray:
    """For each share of SHAPES a one in the bin it falls in: len(SHAPES) * (len(SHAPE_CUTS) + 1) terms."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "uint8"), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = max(len(words), 1), max(int(raw.sum()), 1)
    upper, lower, digit, sign = (int(raw[k].sum()) for k in (_UPPER, _LOWER, _DIGIT, _SIGN))
    bare = [w for w in words if not w[-1].isalnum()]
    shares = (
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        upper / max(upper + lower, 1),
        sign / chars,
        digit / chars,
        sum(not any(map(str.isalnum, w)) for w in bare) / n,
        sum(w[-1] not in ".,;:!?" for w in bare) / n,
        sum(len(x) < 40 for x in lines) / max(len(lines), 1),
        len(set(words)) / n,
    )
    out = np.zeros((len(SHAPES), len(SHAPE_CUTS) + 1), "float32")
    out[np.arange(len(SHAPES)), np.searchsorted(SHAPE_CUTS, shares)] = 1
    return out.ravel()
