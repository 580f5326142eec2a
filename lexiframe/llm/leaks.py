"""Problem 9: evaluation passages inside a training corpus.

Method: pigeonhole edit matching. Each window of a test item is split into error-budget-plus-one pieces; a corpus text within the error
budget of the window holds one of the pieces unchanged. The pieces are found exactly (one automaton for all items), and each hit is
verified with Myers' bit-parallel distance over the window's surroundings.

Texts are compared as words: composed letters, digits and marks in small letters, apostrophes dropped, everything else is a border. Test
items are the query set; they are sent to the workers in blocks of checked size. The corpus is read once per block and never shuffled.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edits import best_window

WINDOW = 10  #: words of a window
BUDGET = 1  #: edits of letters allowed in a window
BLOCK = 16 << 20  #: characters of test items per pass over the corpus, about
_JOINED = "'’‘ʻʼ`´ʹ"
_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M")
_FAR_MARKS = "".join(chr(c) for c in range(0x10000, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M")
_UNSEEN = "\u0301\u00ad\u200b\u200c\u200d\u2060\ufeff"  #: stress marks that nothing composes with, and invisible characters
_PLAIN = r"[^\W_]+"
_MARKED, _FAR_MARKED = rf"(?:[^\W_]+|[{_MARKS}]+)+", rf"(?:[^\W_]+|[{_MARKS}]+|[{_FAR_MARKS}]+)+"
_REST = r"(?:[{j}]+{w}|(?<=\d)[.,](?=\d)\d+)*"
_WORD, _MARKED_WORD, _FAR_WORD = (re.compile(w + _REST.format(j=_JOINED, w=w)) for w in (_PLAIN, _MARKED, _FAR_MARKED))
#: A class within the first plane is a bitmap, one beyond it a list that is walked for each character: texts with far characters go apart.
_HAS_MARK, _HAS_FAR = re.compile(f"[{_MARKS}]"), re.compile("[\U00010000-\U0010ffff]")
_DROP = str.maketrans("", "", _JOINED + ".,")
_DROPPED = re.compile(r"['`]|\d[.,]\d")  #: what of _DROP an ASCII word may hold


def words_of(text: str) -> list[str]:
    """Words in small letters, composed; marks belong to their letters. Apostrophes inside words, points inside numbers, stress marks and
    invisible characters fall out."""
    low = text.lower()
    if low.isascii():
        return _WORD.findall(low) if not _DROPPED.search(low) else [x.translate(_DROP) for x in _WORD.findall(low)]
    low = unicodedata.normalize("NFC", low)
    for c in _UNSEEN:
        if c in low:
            low = low.replace(c, "")
    found = (_FAR_WORD if _HAS_FAR.search(low) else _MARKED_WORD if _HAS_MARK.search(low) else _WORD).findall(low)
    return [w for w in (x.translate(_DROP) for x in found) if w]


def item_pieces(items: list[tuple[int, str]], window: int, budget: int) -> dict[str, list[tuple[int, int]]]:
    """Pieces (word sequences with blanks around) of all windows of all items: piece -> (item index, word offset)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for i, (_, passage) in enumerate(items):
        w = [x.translate(_DROP) for x in words_of(passage)]
        for start in range(max(1, len(w) - window + 1)):
            part = w[start : start + window]
            n = min(budget + 1, len(part)) or 1
            edges = [round(k * len(part) / n) for k in range(n + 1)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = out.setdefault(" " + " ".join(part[a:b]) + " ", [])
                if not at or (i, start + a) not in at:
                    at.append((i, start + a))
    return out


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """(item_id, doc_id, words, edits, doc_word, item_word): the longest exact run of words that a document shares with an item around
    each place where a window of the item stands in it with at most `budget` edits, and the least number of edits of such a window.

    Items shorter than a window are matched as a whole. Null or empty passages and texts match nothing; repeated rows match each. Extra
    columns are not read.
    """
    out = None
    size = items.agg(F.sum(F.char_length(passage))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == k)
        rows = [(r[item_id], r[passage]) for r in part.select(item_id, passage).collect() if r[item_id] is not None and r[passage]]  # about BLOCK characters
        found = _search(docs, doc_id, text, rows, items.schema[item_id].dataType.simpleString(), window, budget)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, doc_id: str, text: str, rows: list[tuple[int, str]], id_type: str, window: int, budget: int) -> DataFrame:
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast((rows, item_pieces(rows, window, budget)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        rows, table = pieces.value
        item_words = [[x.translate(_DROP) for x in words_of(p)] for _, p in rows]
        auto = ahocorasick.Automaton()
        for p, at in table.items():
            auto.add_word(p, (len(p), at))
        if table:
            auto.make_automaton()
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["t"], strict=True):
                if not t or not table:
                    continue
                flat = " " + " ".join(words_of(t)) + " "
                hits: dict[tuple[int, int], int] = {}
                spots: list[tuple[int, int, int]] = []
                for end, (size, at) in auto.iter(flat):
                    spots += [(end - size + 1, i, off) for i, off in at]
                if not spots:
                    continue
                spots.sort()
                word_at, seen = 0, 0
                words = flat.split()
                best: dict[int, tuple] = {}
                for pos, i, off in spots:
                    word_at += flat.count(" ", seen, pos)
                    seen = pos
                    w = item_words[i]
                    done = hits.get((i, word_at - off), -1)
                    if word_at < done:
                        continue
                    # the exact run around the hit
                    a, c = word_at, off
                    while a > 0 and c > 0 and words[a - 1] == w[c - 1]:
                        a, c = a - 1, c - 1
                    e, g = word_at, off
                    while e < len(words) and g < len(w) and words[e] == w[g]:
                        e, g = e + 1, g + 1
                    hits[i, word_at - off] = e
                    run = e - a
                    need = min(window, len(w))
                    # Myers over the windows that hold the run; within a long run, over its first window
                    edits = budget + 1
                    for s in range(max(0, g - need), min(c, len(w) - need) + 1) if run < need else (c,):
                        pattern = " ".join(w[s : s + need])
                        lo = max(0, a - (c - s) - budget)
                        area = " ".join(words[lo : lo + need + 2 * budget])
                        edits = min(edits, best_window(pattern, area)[0])
                    if edits > budget:
                        continue
                    got = (run, -edits)
                    if i not in best or got > best[i][:2]:
                        best[i] = (run, -edits, a, c)
                out += [(rows[i][0], d, run, -neg, a, c) for i, (run, neg, a, c) in best.items()]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "words", "edits", "doc_word", "item_word"])

    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")
    return read.mapInPandas(work, f"item_id {id_type}, doc_id {kind}, words int, edits int, doc_word int, item_word int")
