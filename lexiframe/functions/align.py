"""Alignment of word sequences: distances in the JVM, operations in Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import APOSTROPHES

OPS = "struct<subs: int, dels: int, ins: int, ops: array<struct<op: string, ref: string, hyp: string, ref_idx: int>>>"


def word_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance of two word arrays. Each distinct word of the pair becomes one code point, so that the built-in function
    counts words. Exact for up to some 50,000 distinct words a pair."""

    def coded(ws: Column, vocab: Column) -> Column:
        def code(w: Column) -> Column:
            k = F.array_position(vocab, w) + 0x100
            return F.lpad(F.hex(F.when(k >= 0xD800, k + 0x2000).otherwise(k)), 4, "0")

        return F.decode(F.unhex(F.array_join(F.transform(ws, code), "")), "UTF-16BE")

    # a one-element array binds the vocabulary, which would else be made again for each word
    vocab = F.array(F.array_distinct(F.concat(ref, hyp)))
    return F.get(F.transform(vocab, lambda v: F.levenshtein(coded(ref, v), coded(hyp, v))), 0)


def close_spelling(a: Column, b: Column, most: int = 2) -> Column:
    """True if two words are at most `most` letters apart."""
    return F.coalesce(F.levenshtein(a, b, most) >= 0, F.lit(False))


def align_pair(ref: list[str], hyp: list[str]) -> tuple[int, int, int, list[tuple[str, str | None, str | None, int]]]:
    """(substitutions, deletions, insertions, operations); ties go to the diagonal, then to deletion, then to insertion."""
    n, m = len(ref), len(hyp)
    rows = [list(range(m + 1))]
    for i in range(1, n + 1):
        above, row, w = rows[-1], [i], ref[i - 1]
        for j in range(1, m + 1):
            if w == hyp[j - 1]:
                row.append(above[j - 1])
            else:
                row.append(1 + min(above[j - 1], above[j], row[j - 1]))
        rows.append(row)
    i, j, out = n, m, []
    counts = {"sub": 0, "del": 0, "ins": 0}
    while i or j:
        same = i and j and ref[i - 1] == hyp[j - 1]
        if same and rows[i][j] == rows[i - 1][j - 1]:
            i, j, op = i - 1, j - 1, ("eq", ref[i - 1], hyp[j - 1], i - 1)
        elif i and j and rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j, op = i - 1, j - 1, ("sub", ref[i - 1], hyp[j - 1], i - 1)
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i, op = i - 1, ("del", ref[i - 1], None, i - 1)
        else:
            j, op = j - 1, ("ins", None, hyp[j - 1], max(i - 1, 0))
        if op[0] != "eq":
            counts[op[0]] += 1
        out.append(op)
    return counts["sub"], counts["del"], counts["ins"], out[::-1]


def _align(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    got = [align_pair([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(ref, hyp, strict=True)]
    return pd.DataFrame({"subs": [g[0] for g in got], "dels": [g[1] for g in got], "ins": [g[2] for g in got], "ops": [[dict(zip(("op", "ref", "hyp", "ref_idx"), o, strict=True)) for o in g[3]] for g in got]})


def align_ops(ref: Column, hyp: Column) -> Column:
    """Alignment of word arrays; a null side counts as empty. The function is made per call: workers import this module without a session."""
    return F.pandas_udf(_align, OPS)(ref, hyp)


def blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    return [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]


def _blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"i": i, "j": j, "n": n} for i, j, n in blocks(list(x), list(y))] if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def matching_blocks(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp blocks of two word arrays; null if one is null."""
    return F.pandas_udf(_blocks, "array<struct<i: int, j: int, n: int>>")(a, b)


def map_index(pairs: list[tuple[int, int]], i: int, tolerance: int = 3) -> int | None:
    """As-of both ways: the index that the nearest anchor before or after i implies, if it is within the tolerance."""
    before = max((p for p in pairs if p[0] <= i), default=None)
    after = min((p for p in pairs if p[0] >= i), default=None)
    found = [(abs(i - p[0]), p[1] + i - p[0]) for p in (before, after) if p]
    if not found or min(found)[0] > tolerance:
        return None
    return min(found)[1]


def anchor_times(ref: list[str], hyp: list[str], times: list[tuple[float, float]]) -> dict[int, tuple[float, float]]:
    """Times of the reference words that stand unchanged in the hypothesis; substituted words carry none."""
    out, j = {}, 0
    for op, _, h, i in align_pair(ref, hyp)[3]:
        if op == "eq":
            out[i] = times[j]
        if h is not None:
            j += 1
    return out


def best_word_window(segment: list[str], hyp: list[str], at: int, reach: int = 40, gate: float = 0.25) -> tuple[float, int, int] | None:
    """(error rate, start, end) of the part of hyp, from `at` on, that fits the segment best; None if it misses the gate."""
    best = None
    n = len(segment)
    for start in range(at, min(len(hyp), at + reach) + 1):
        for size in {max(1, n - 2), n, n + 2}:
            part = hyp[start : start + size]
            if part:
                s, d, i, _ = align_pair(segment, part)
                rate = (s + d + i) / max(n, 1)
                if best is None or rate < best[0]:
                    best = (rate, start, start + len(part))
    return best if best and best[0] <= gate else None


def anchored_index(pairs: Column, i: Column, tolerance: int = 3) -> Column:
    """map_index as a column over array<struct<hyp, ref>>: null without an anchor near enough; of equally near ones the smaller result."""
    near = F.filter(pairs, lambda p: F.abs(p["hyp"] - i) <= tolerance)
    sides = [F.filter(near, lambda p: p["hyp"] <= i), F.filter(near, lambda p: p["hyp"] >= i)]
    last = F.array_max(F.transform(sides[0], lambda p: F.struct(p["hyp"].alias("hyp"), p["ref"].alias("ref"))))
    first = F.array_min(F.transform(sides[1], lambda p: F.struct(p["hyp"].alias("hyp"), p["ref"].alias("ref"))))
    found = F.filter(F.array(last, first), lambda p: p.isNotNull())
    return F.array_min(F.transform(found, lambda p: F.struct(F.abs(i - p["hyp"]).alias("d"), (p["ref"] + i - p["hyp"]).alias("at"))))["at"]


def _anchored(ref: pd.Series, hyp: pd.Series, times: pd.Series) -> pd.Series:
    out = []
    for r, h, t in zip(ref, hyp, times, strict=True):
        got = anchor_times(list(r), list(h), [(x["start"], x["end"]) for x in t])
        out.append([{"ref_idx": i, "start": a, "end": b} for i, (a, b) in sorted(got.items())])
    return pd.Series(out)


def anchored_times(ref: Column, hyp: Column, times: Column) -> Column:
    """anchor_times as a column: array<struct<ref_idx, start, end>> of the reference words that were recognised unchanged."""
    return F.pandas_udf(_anchored, "array<struct<ref_idx: int, start: double, end: double>>")(ref, hyp, times)


def project_roles(piece: str, whole: list[str], roles: list[str | None], least: float = 0.90) -> tuple[str | None, float]:
    """(the piece with [ROLE] where the role changes, share of its words found). whole: canonical words of the call with their roles. Words
    that aren't found take the role before them, the first ones the first known; a piece with a smaller share than `least` gets None."""
    tokens = piece.split()
    bare = [(k, w) for k, w in ((k, _bare(t)) for k, t in enumerate(tokens)) if w]
    if not bare:
        return None, 0.0
    found: dict[int, str | None] = {}
    for i, j, n in blocks(whole, [w for _, w in bare]):
        found.update({bare[j + k][0]: roles[i + k] for k in range(n)})
    share = len(found) / len(bare)
    if share < least:
        return None, share
    role = next((found[k] for k in sorted(found) if found[k]), None)
    out, said = [], None
    for k, t in enumerate(tokens):
        role = found.get(k) or role
        if role != said and role:
            out.append(f"[{role.upper()}]")
            said = role
        out.append(t)
    return " ".join(out), share


def _bare(w: str) -> str:
    return "".join(c for c in w.translate(str.maketrans(dict.fromkeys(APOSTROPHES, "'"))).lower() if c.isalnum() or c in "_'")


def _projected(piece: pd.Series, tokens: pd.Series) -> pd.DataFrame:
    rows = [project_roles(p, [x["word"] for x in t], [x["role"] for x in t]) if p is not None and t is not None else (None, None) for p, t in zip(piece, tokens, strict=True)]
    return pd.DataFrame(rows, columns=["turns", "role_match"])


def projected_roles(piece: Column, tokens: Column) -> Column:
    """project_roles as a column: struct<turns, role_match> of a text and array<struct<word, role>>; null without tokens."""
    return F.pandas_udf(_projected, "struct<turns: string, role_match: double>")(piece, tokens)


def _windows(segments: pd.Series, hyp: pd.Series) -> pd.Series:
    out = []
    for segs, h in zip(segments, hyp, strict=True):
        h, at, rows = list(h), 0, []
        for k, s in enumerate(segs):
            s = list(s)
            row = {"segment": k, "note": None, "ref_words": len(s), "hyp_words": None, "errors": None}
            same = blocks(s, h[at:]) if len(s) >= 3 else []
            if len(s) < 3:
                row["note"] = "short"
            elif sum(n for _, _, n in same) < 0.25 * len(s) or not same:
                row["note"] = "unreliable"
            else:
                begin, end = same[0][1], same[-1][1] + same[-1][2]
                part = h[at:][max(begin - 2, 0) : end + 2]
                row |= {"hyp_words": len(part), "errors": sum(align_pair(s, part)[:3])}
                at += max(end - 1, 1)
            rows.append(row)
        out.append(rows)
    return pd.Series(out)


def segment_windows(segments: Column, hyp: Column) -> Column:
    """Scores the segments (array<array<string>>, in order) of a call inside the words of its whole hypothesis: each segment's place is
    where its matching blocks lie behind the segment before; under a quarter of matching words it is unreliable, under three words
    short. array<struct<segment, note, ref_words, hyp_words, errors>>."""
    return F.pandas_udf(_windows, "array<struct<segment: int, note: string, ref_words: int, hyp_words: int, errors: int>>")(segments, hyp)
