"""Longest common subsequences: by long integers for a pair of long texts, by numpy words for many pairs of short ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Up to this many characters, pairs are worked on together.
SHORT = 512
PAIRS = 4096
_PAD_A, _PAD_B = 0xFFFFFFFE, 0xFFFFFFFF


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a step per sign of the shorter text, a bit per sign of the longer."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_bits = full
    for sign in b:
        hit = open_bits & places.get(sign, 0)
        if hit:
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def _codes(texts: Sequence[str], width: int, pad: int) -> np.ndarray:
    table = np.full((len(texts), width), pad, np.uint32)
    for row, text in enumerate(texts):
        table[row, : len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table


def _together(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths for pairs of like size: a step per place of `b`, a row of 64-bit words per pair."""
    words = max(1, -(-max(map(len, a)) // 64))
    left = _codes(a, words * 64, _PAD_A)
    right = _codes(b, max(1, max(map(len, b))), _PAD_B)
    open_bits = np.full((len(a), words), ~np.uint64(0))
    for at in range(right.shape[1]):
        hits = np.packbits(left == right[:, at:at + 1], axis=1, bitorder="little").view(np.uint64)
        taken = open_bits & hits
        moved = np.empty_like(open_bits)
        carry = np.zeros(len(a), np.uint64)
        for word in range(words):
            part = open_bits[:, word] + taken[:, word]
            over = part < taken[:, word]
            whole = part + carry
            moved[:, word] = whole
            carry = (over | (whole < part)).astype(np.uint64)
        open_bits = moved | (open_bits & ~hits)
    return words * 64 - np.bitwise_count(open_bits).sum(axis=1, dtype=np.int64)


def common_subsequences(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts."""
    lengths = np.zeros(len(a), np.int64)
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    order = np.argsort(longest, kind="stable")
    short = order[longest[order] <= SHORT]
    for start in range(0, len(short), PAIRS):
        rows = short[start:start + PAIRS]
        lengths[rows] = _together([a[r] for r in rows], [b[r] for r in rows])
    for row in order[len(short):]:
        lengths[row] = common_subsequence(a[row], b[row])
    return lengths


def indel_ratios(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """Edit ratio of pairs, where a replacement counts as two edits; 0 if either text is missing or empty."""
    ratios = np.zeros(len(a))
    rows = [r for r, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
    left, right = [a[r] for r in rows], [b[r] for r in rows]
    total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)])
    if rows:
        ratios[rows] = 2.0 * common_subsequences(left, right) / total
    return ratios
