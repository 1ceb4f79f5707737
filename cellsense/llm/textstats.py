"""Statistics of a whole text, computed on its UTF-8 bytes; shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

#: Character classes of the histogram, by first byte: what continues a character has class 8 and isn't counted.
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "wide")
BYTE_CLASS = np.full(256, 5, dtype=np.uint8)
for _b in range(256):
    if 97 <= _b <= 122:
        BYTE_CLASS[_b] = 0
    elif 65 <= _b <= 90:
        BYTE_CLASS[_b] = 1
    elif 48 <= _b <= 57:
        BYTE_CLASS[_b] = 2
    elif _b in SPACE:
        BYTE_CLASS[_b] = 3
    elif _b in b".,;:?'\"()-":
        BYTE_CLASS[_b] = 4
    elif _b in SYMBOLS:
        BYTE_CLASS[_b] = 6
    elif _b >= 192:
        BYTE_CLASS[_b] = 7
    elif _b >= 128:
        BYTE_CLASS[_b] = 8


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(BYTE_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=9)[:8]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), dtype=np.int64, count=len(words))
    base, key = len(table), ids[:n].copy()
    for k in range(1, width):
        key = key * base + ids[k : n + k]
        if base**width >= 1 << 62:  # then fold each level to its own small numbers, so that products can't overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(n, dtype=bool)
    equal = s[1:] == s[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    if not same.any():
        return 0
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    at = order[same]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + width, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))
