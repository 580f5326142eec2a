"""Edit distance by bit vectors (Myers 1999), on Python integers of any length."""

from __future__ import annotations

from collections.abc import Sequence


def myers_distance(a: Sequence, b: Sequence, limit: int | None = None) -> int:
    """Levenshtein distance of two sequences; limit + 1 if it is above limit."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if limit is not None and n - m > limit:
        return limit + 1
    if not m:
        return n
    seen: dict = {}
    for i, x in enumerate(a):
        seen[x] = seen.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, y in enumerate(b):
        eq = seen.get(y, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(h | up) & full, up & h
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if limit is not None and score - (n - j - 1) > limit:
            return limit + 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up, down = fall | ~(v | rise) & full, rise & v
    return score if limit is None or score <= limit else limit + 1


def best_window(pattern: Sequence, text: Sequence) -> tuple[int, int]:
    """(least distance of the pattern to any part of text, end of that part): Myers' search form."""
    m = len(pattern)
    if not m:
        return 0, 0
    seen: dict = {}
    for i, x in enumerate(pattern):
        seen[x] = seen.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, y in enumerate(text):
        eq = seen.get(y, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(h | up) & full, up & h
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(v | rise) & full, rise & v
        if score < best:
            best, at = score, j + 1
    return best, at
