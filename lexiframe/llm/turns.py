"""Problem 6: speech transcripts into clean speaker turns.

Method: labels are normalised, variants are clustered by initial and string similarity with union-find within each transcript, and
turns are collapsed under the canonical speakers. A transcript is one row and is worked on where it lies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded_rows
from .edits import myers_distance

UNKNOWN = "nomalum"
MAX_LABEL = 32
# Marks of time before a text: [00:00:08] (0:13) <52.8s> [7.14 - 13.36] 00:00:05,860 00:00:02.060 --> 00:00:10.200 00:05
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIME = re.compile(
    rf"\s*(?:[\[(<]\s*(?P<a>{_CLOCK}|\d+(?:[.,]\d+)?)\s*s?\s*(?:(?:-|–|-->)\s*(?:{_CLOCK}|\d+(?:[.,]\d+)?)\s*s?\s*)?[\])>]|(?P<b>{_CLOCK})(?:\s*-->\s*{_CLOCK})?(?=\s|$))\s*"
)
_NOTE = re.compile(r"\(\([^()]*\)\)|\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|\*[^*\n]+\*|[♪♫♬]+")
_LABEL = re.compile(rf"\s*(?:\[(?P<a>[^\]\n]{{1,{MAX_LABEL}}})\]|<(?P<b>[^>\n]{{1,{MAX_LABEL}}})>|\((?P<c>[^)\n]{{1,{MAX_LABEL}}})\)|(?P<d>[^\s:\[\]<>()][^:\n]{{0,{MAX_LABEL}}}?)\s*:(?=\s|$)|(?P<e>[^\s:\[\]<>()][^:\n]{{0,{MAX_LABEL}}}?)\s+[-–—](?=\s|$))\s*")
# Sounds of hesitation, Latin and Cyrillic.
_HESITATION = re.compile(r"a(-?a)+|e(-?e)+m*|m(-?m)+|m?h+m+|u+h+m+|а(-?а)+|э(-?э)+м*|э+м+|м(-?м)+|х+м+|г+м+")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def normal_label(label: str) -> str:
    """Small letters without brackets, numbers and marks; '?' stays."""
    x = label.strip().lower()
    bare = re.sub(r"[\W\d_]+", " ", x).strip()
    return bare or ("?" if "?" in x else "")


class Clusters:
    """Union-find over labels."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def similar(a: str, b: str) -> bool:
    """Same initial, or the first two letters swapped, and at most two edits that leave over half of the shorter label."""
    if not a or not b or (a[0] != b[0] and a[:2] != b[1::-1]):
        return False
    limit = min(2, (min(len(a), len(b)) - 1) // 2)
    return myers_distance(a, b, limit) <= limit


def canonical_speakers(labels: list[str], known: dict[str, str]) -> dict[str, str]:
    """Speaker of each normalised label of one transcript: labels and the known spellings are clustered, a cluster is whom its known
    spelling stands for. A label similar to spellings of several speakers goes to the nearest. The speaker of a cluster without a known
    spelling is unknown and named by the cluster, so that several of them stay apart; a label without letters is just unknown."""
    c = Clusters()
    fresh = sorted({x for x in labels if x} - known.keys())
    for x in fresh:
        near = [(myers_distance(x, k), k) for k in known if similar(x, k)]
        if near:
            c.join(x, min(near)[1])
    for i, x in enumerate(fresh):
        for y in fresh[:i]:
            rx, ry = c.root(x), c.root(y)
            if rx != ry and similar(x, y) and not (rx in known and ry in known):
                c.join(x, y)
    of_root: dict[str, str] = {}
    for k in sorted(known):
        of_root.setdefault(c.root(k), known[k])
    return {x: known.get(x) or of_root.get(c.root(x)) or (f"{UNKNOWN}:{c.root(x)}" if any(ch.isalpha() for ch in x) else UNKNOWN) for x in labels if x}


def _seconds(clock: str) -> float:
    out = 0.0
    for part in clock.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


def _take_label(text: str, known: dict[str, str]) -> tuple[str | None, str]:
    m = _LABEL.match(text)
    if m:
        raw = next(x for x in m.groups() if x is not None)
        x = normal_label(raw)
        if x and (x in known or any(similar(x, k) for k in known)):
            return x, text[m.end() :]
    return None, text


def spoken(text: str) -> list[str]:
    """The words of a text: no sound notes, no hesitations, blank-separated tokens with a letter or digit."""
    out = []
    for w in _NOTE.sub(" ", text).split():
        core = _EDGE.sub("", w)
        if core and any(ch.isalnum() for ch in core) and not _HESITATION.fullmatch(core.lower()):
            out.append(w)
    return out


def transcript_turns(segments: str | None, full_text: str | None, known: dict[str, str]) -> list[tuple[str, list[str]]]:
    """(speaker, words) of each turn of one transcript."""
    try:
        segs = json.loads(segments) if segments else []
    except ValueError:
        segs = []
    items = []  # (start or None, label or None, text)
    if isinstance(segs, list) and segs:
        for g in segs:
            if isinstance(g, dict):
                field = next((str(g[k]) for k in ("role", "speaker") if g.get(k) not in (None, "") and normal_label(str(g[k]))), None)
                start = g.get("start")
                items.append((float(start) if isinstance(start, int | float) and start == start else None, field, str(g.get("text") or "")))
        given = [(s, normal_label(f) if f else None, t) for s, f, t in items]
    else:
        given = [(None, None, line) for line in (full_text or "").splitlines()]
    rows = []
    last = float("-inf")
    for pos, (start, label, text) in enumerate(given):
        found = None
        for _ in range(3):
            m = _TIME.match(text)
            if not m:
                break
            if start is None and not segs:
                clock = m.group("a") or m.group("b")
                start = _seconds(clock)
            text = text[m.end() :]
        found, rest = _take_label(text, known)
        if found:
            text = rest
            m = _TIME.match(text)
            if m and m.end() < len(text):
                text = text[m.end() :]
        last = start if start is not None else last
        rows.append((last, pos, label or found, text))
    rows.sort(key=lambda r: r[:2])
    names = canonical_speakers([r[2] for r in rows if r[2]], known)
    turns: list[tuple[str, list[str]]] = []
    speaker = UNKNOWN
    for _, _, label, text in rows:
        if label:
            speaker = names[label]
        words = spoken(text)
        if not words:
            continue
        if turns and turns[-1][0] == speaker:
            turns[-1][1].extend(words)
        else:
            turns.append((speaker, words))
    return turns


def speaker_turns(transcripts: DataFrame, labels: DataFrame) -> DataFrame:
    """(call_key, turn_no from 1, speaker, n_words, text).

    Rows of one call_key count once (repeats are equal; if they differ, the row with the longest segments, then text, stands). A null
    call_key, or a transcript without words, gives no turn. Segments go by start where given; one without a start stays behind the one
    before it. A segment that nothing labels goes to the speaker before; before any label the speaker is unknown.
    """
    known = {normal_label(r["label"]): r["speaker"] for r in bounded_rows(labels, 10_000, "speaker_labels") if r["label"]}
    best = F.max_by(F.struct("segments_json", "full_text"), F.struct(F.coalesce(F.length("segments_json"), F.lit(0)), F.coalesce(F.length("full_text"), F.lit(0)), F.xxhash64("segments_json", "full_text")))
    one = transcripts.where("call_key is not null").groupBy("call_key").agg(best.alias("t")).select("call_key", "t.segments_json", "t.full_text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, seg, full in zip(b["call_key"], b["segments_json"], b["full_text"], strict=True):
                for n, (who, words) in enumerate(transcript_turns(seg, full, known), 1):
                    out.append((key, n, who, len(words), " ".join(words)))
            yield pd.DataFrame(out, columns=["call_key", "turn_no", "speaker", "n_words", "text"])

    return one.mapInPandas(work, "call_key string, turn_no int, speaker string, n_words int, text string")
