"""Problem 4: records of an evaluation split that stand again, exactly or almost, in the training split.

Method: a weighted cosine join. A text is a vector of its character grams, weighted by their rarity over both splits. Blocks of the
evaluation texts (the query set) meet blocks of training texts of similar length; a block of training texts is a set of inverted lists.
No pair within k edits is lost: k edits destroy at most qk of a text's grams, so what is left of it, at least its lightest grams, bounds
the dot product from below (`least`). By that bound

* maximum weights prune: a gram that no text of the other side holds adds nothing, and a text whose other grams can't reach `least` has
  no partner in the block;
* residual norms prune: the lightest grams, whose squares stay below a share of `least`, aren't in the lists; a pair whose products and
  residual stay below the bound is dropped.

The dot products of what is left are exact; pairs that reach the bound are compared by bit sketches, whose collisions only lower the counts,
and at last by Myers' edit distance. Texts are joined once per distinct form: copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .edits import myers_distance
from .forms import canonical_texts, text_key

SLICE = 8192  #: texts of a side in a block, about
STEP = 512  #: texts sketched together
SHARE = 0.4  #: of the least product; what stays below it is multiplied only for the pairs that the heavier grams leave
CELLS = 1 << 18  #: the table of gram frequencies is hashed to this size
WIDTH = 16  #: half letters in a place of the sketch of places
PLACED_BITS = 4096
_MIX = 0x9E3779B97F4A7C15


def folded(form: Column) -> Column:
    """Letters and digits of a canonical form, in small letters."""
    return F.regexp_replace(F.lower(form), r"[^\p{L}\p{N}]", "")


def gram_size(max_edits: float) -> int:
    """Longest grams of which some survive that share of edits, at most 5."""
    return max(1, min(5, int(1 / max_edits) - 1)) if max_edits > 0 else 5


def most_destroyed(n: int, q: int, max_edits: float) -> int:
    """Most grams of a text of n letters that a partner within the limit may lack: an edit destroys q, a letter put in q - 1; the partner
    has up to n / (1 - max_edits) letters, and what it has more was put in."""
    return max(q * int(m * max_edits + 1e-9) - (m - n) for m in range(n, int(n / (1 - max_edits) + 1e-6) + 1))


def _grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each gram, index of its text, its place); a text shorter than q has none."""
    lens = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.maximum(lens - q + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place + np.repeat(np.cumsum(lens) - lens, counts)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            h = (h ^ flat[at + j]) * np.uint64(_MIX)
            h ^= h >> np.uint64(29)
    return h, owner, place


def _stepped(f: Callable[[list[str]], np.ndarray], texts: list[str]) -> np.ndarray:
    return np.concatenate([f(texts[i : i + STEP]) for i in range(0, len(texts), STEP)])


def _counted(texts: list[str], q: int, buckets: int, most: int) -> np.ndarray:
    """Counts of hashed grams up to `most` in unary, as words of 64 bits: two texts differ in at most as many bits as grams."""

    def sketch(part: list[str]) -> np.ndarray:
        h, owner, _ = _grams(part, q)
        b = ((h >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
        n = np.bincount(owner * buckets + b, minlength=len(part) * buckets)
        return np.packbits((np.arange(most) < n[:, None]).reshape(len(part), -1), axis=1).view(np.uint64)

    return _stepped(sketch, texts)


def _placed(texts: list[str], q: int, share: float | None) -> np.ndarray:
    """Hashed grams with their place from the middle; with `share`, at all places where a text within that share of edits may have them."""

    def sketch(part: list[str]) -> np.ndarray:
        h, owner, place = _grams(part, q)
        n = np.array([len(t) for t in part], np.int64)[owner]
        middle = 2 * place - n
        reach = np.zeros(len(n), np.int64) if share is None else (n * (share / (1 - share)) + 1e-9).astype(np.int64)  # edits of the longest partner
        lo, hi = (middle - reach) // WIDTH, (middle + reach) // WIDTH
        bits = np.zeros((len(part), PLACED_BITS), bool)
        for s in range(int((hi - lo).max(initial=0)) + 1):
            k = lo + s <= hi
            with np.errstate(over="ignore"):
                x = (h[k] ^ (lo[k] + s).astype(np.uint64)) * np.uint64(_MIX)
            bits[owner[k], ((x >> np.uint64(40)) % np.uint64(PLACED_BITS)).astype(np.int64)] = True
        return np.packbits(bits, axis=1).view(np.uint64)

    return _stepped(sketch, texts)


class Vectors:
    """Weighted grams of texts: owner, gram (with the number of its occurrence in the text) and squared weight, the heaviest of a text
    first; and per text the least dot product with any partner, 0 if edits may destroy all of its grams."""

    def __init__(self, texts: list[str], q: int, max_edits: float, squares: np.ndarray) -> None:
        self.n = len(texts)
        bits = np.uint64(max(1, self.n.bit_length()))
        h, owner, _ = _grams(texts, q)
        above = owner.astype(np.uint64) << (np.uint64(64) - bits)
        h = h[np.argsort(above | h >> bits)]  # the owners are in order already
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        at = np.arange(len(h))
        nth = at - np.maximum.accumulate(np.where(first, at, 0))
        with np.errstate(over="ignore"):
            gram = (h ^ nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(_MIX)
        cell = _cell(h)
        rank = np.empty(len(squares), np.uint64)
        rank[np.argsort(-squares, kind="stable")] = np.arange(len(squares), dtype=np.uint64)
        by = np.argsort(above | rank[cell] << (np.uint64(64) - bits - np.uint64(20)) | gram >> (bits + np.uint64(20)), kind="stable")
        self.owner, self.gram, self.w2 = owner, gram[by], squares[cell[by]]
        self.size = np.bincount(owner, minlength=self.n)
        lost = {n: most_destroyed(n, q, max_edits) for n in {len(t) for t in texts}}
        kept = self.size - np.array([lost[len(t)] for t in texts], np.int64)
        self.free = kept <= 0
        self.ends = np.cumsum(self.size)
        from_end = self.ends[owner] - at
        self.least = np.bincount(owner, np.where(from_end <= kept[owner], self.w2, 0.0), minlength=self.n) * (1 - 1e-9)

    def prune(self, held: np.ndarray) -> np.ndarray:
        """Which grams are multiplied, given which of them the other side holds: all but the lightest whose squares stay below SHARE of the
        least product, and none of a text that can't reach it. Sets `rest`, the squares left out."""
        w2 = np.where(held, self.w2, 0.0)
        cum = np.concatenate([[0.0], np.cumsum(w2[::-1])])[::-1]
        after = cum[:-1] - cum[self.ends[self.owner]]  # this gram and the lighter ones of its text
        can = np.bincount(self.owner, w2, minlength=self.n) >= self.least - 1e-6
        opens = held & (after >= SHARE * self.least[self.owner] - 1e-6)
        self.rest = np.bincount(self.owner, np.where(opens, 0.0, w2), minlength=self.n)
        return opens & can[self.owner]

    def grams(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k = slice(self.ends[i] - self.size[i], self.ends[i])
        return self.gram[k], self.w2[k]

    def dot(self, i: int, other: Vectors, j: int) -> float:
        """Exact product of text i with text j of the other side."""
        g, w2 = self.grams(i)
        there = set(other.grams(j)[0].tolist())
        return sum(w for x, w in zip(g.tolist(), w2.tolist(), strict=True) if x in there)


def _cell(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(23)) % np.uint64(CELLS)).astype(np.int64)


def gram_squares(texts: DataFrame, q: int) -> np.ndarray:
    """Squared weights, the root of log(1 + all grams / count), by hashed gram, from the counts over all texts (column text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(CELLS)
        for b in batches:
            for i in range(0, len(b), STEP):
                n += np.bincount(_cell(_grams(list(b["text"][i : i + STEP]), q)[0]), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": n[at]})

    got = texts.select("text").mapInPandas(count, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    n = np.zeros(CELLS)
    n[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy()
    return np.sqrt(np.log1p(max(n.sum(), 1.0) / np.maximum(n, 1.0)))


def cosine_candidates(left: Vectors, right: Vectors, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(indices in left, index in right) of the pairs that may reach both least products, the left ones within lo..hi of the right one.
    Texts without a bound come with all partners."""
    lists = starts = owners = np.zeros(0, np.int64)
    some = len(left.gram) and len(right.gram)
    if some:
        l_held, r_held = np.isin(left.gram, right.gram), np.isin(right.gram, left.gram)
        l_opens, r_opens = left.prune(l_held), right.prune(r_held)
        grams = left.gram[l_opens]
        by = np.argsort(grams, kind="stable")
        grams, owners = grams[by], left.owner[l_opens][by]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        lists, starts = grams[new], np.concatenate([np.flatnonzero(new), [len(grams)]])
        some = len(lists)
    if some:
        at = np.minimum(np.searchsorted(lists, right.gram), len(lists) - 1)
        k = np.flatnonzero(r_opens & (lists[at] == right.gram))
        begin, end, weight, bounds = starts[at[k]], starts[at[k] + 1], right.w2[k], np.searchsorted(right.owner[k], np.arange(right.n + 1))
    free = np.flatnonzero(left.free)
    for j in range(right.n):
        if right.free[j]:
            yield np.arange(lo[j], hi[j]), j
            continue
        got = free[(free >= lo[j]) & (free < hi[j])]
        if some and bounds[j + 1] > bounds[j]:
            span = slice(bounds[j], bounds[j + 1])
            who = np.concatenate([owners[x:y] for x, y in zip(begin[span].tolist(), end[span].tolist(), strict=True)])
            sums = np.bincount(who, np.repeat(weight[span], end[span] - begin[span]), minlength=left.n)[lo[j] : hi[j]]
            sums += np.maximum(right.rest[j], left.rest[lo[j] : hi[j]]) + 1e-6
            reach = (sums >= np.maximum(right.least[j], left.least[lo[j] : hi[j]])) & ~left.free[lo[j] : hi[j]]
            got = np.concatenate([got, lo[j] + np.flatnonzero(reach)])
        if len(got):
            yield got, j


def close_pairs(left: list[str], right: list[str], max_edits: float, squares: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(index in left, index in right, edits) of all pairs whose edit distance is at most max_edits (below 1) of the longer. squares:
    squared weights by hashed gram (`gram_squares`); any positive ones give the same pairs."""
    if not left or not right:
        return
    order = sorted(range(len(left)), key=lambda i: len(left[i]))
    left = [left[i] for i in order]
    q = gram_size(max_edits)
    an, bn = (np.array([len(t) for t in side], np.int64) for side in (left, right))
    lo, hi = np.searchsorted(an, bn * (1 - max_edits) - 1e-6), np.searchsorted(an, bn / (1 - max_edits) + 1e-6, "right")
    x, y = Vectors(left, q, max_edits, squares), Vectors(right, q, max_edits, squares)
    found: list[tuple[np.ndarray, int]] = []
    total = 0
    for i, j in cosine_candidates(x, y, lo, hi):
        found.append((i, j))
        total += len(i)
        if total > 1 << 18:
            yield from ((order[a], b, e) for a, b, e in _verified(left, right, x, y, found, max_edits))
            found, total = [], 0
    yield from ((order[a], b, e) for a, b, e in _verified(left, right, x, y, found, max_edits))


def _verified(left: list[str], right: list[str], x: Vectors, y: Vectors, found: list[tuple[np.ndarray, int]], max_edits: float) -> Iterator[tuple[int, int, int]]:
    """The pairs within the limit: bounds on sketches of letters, grams and grams near their place, the exact product, the edit distance."""
    if not found:
        return
    i, j = np.concatenate([i for i, _ in found]), np.repeat([j for _, j in found], [len(i) for i, _ in found])
    an, bn = (np.array([len(t) for t in side], np.int64) for side in (left, right))
    limit = (np.maximum(an[i], bn[j]) * max_edits + 1e-9).astype(np.int64)

    def sketched(make: Callable[[list[str]], np.ndarray], side: list[str], at: np.ndarray) -> np.ndarray:
        """Sketches of the texts at these indices, each made once."""
        used, at = np.unique(at, return_inverse=True)
        return make([side[k] for k in used])[at]

    def counted(q: int, buckets: int, most: int) -> np.ndarray:
        u, v = (sketched(lambda t: _counted(t, q, buckets, most), side, at) for side, at in ((left, i), (right, j)))
        return np.bitwise_count(u ^ v).sum(1, dtype=np.int64)

    def misplaced(q: int, a: tuple, b: tuple) -> np.ndarray:
        u, v = sketched(lambda t: _placed(t, q, None), *a), sketched(lambda t: _placed(t, q, max_edits), *b)
        return np.bitwise_count(u & ~v).sum(1, dtype=np.int64)

    bounds = [
        lambda: counted(1, 32, 16) <= 2 * limit - np.abs(an[i] - bn[j]),
        lambda: counted(2, 512, 2) <= 4 * limit,
        lambda: misplaced(3, (left, i), (right, j)) <= 3 * limit,
        lambda: misplaced(3, (right, j), (left, i)) <= 3 * limit,
    ]
    for holds in bounds:
        keep = holds()
        i, j, limit = i[keep], j[keep], limit[keep]
        if not len(i):
            return
    for a, b, k in zip(i.tolist(), j.tolist(), limit.tolist(), strict=True):
        if x.dot(a, y, b) >= max(x.least[a], y.least[b]) - 1e-6:
            e = myers_distance(left[a], right[b], k)
            if e <= k:
                yield a, b, e


def edit_links(left: DataFrame, right: DataFrame, max_edits: float) -> DataFrame:
    """(a1, a2, b1, b2, edits): all pairs of distinct texts of left and right with an edit distance of at most that share of the longer.

    left and right: (k1, k2, text), one row per distinct text, no nulls or empty texts. Texts lie in bands of length such that a pair's
    bands are the same or neighbours. A block is a slice of a band of left with a slice of the three bands of right.
    """
    unit = -float(np.log1p(-max_edits)) + 1e-6
    band = F.floor(F.log(F.length("text")) / unit).cast("int")
    left, right = left.withColumn("band", band), right.withColumn("band", band)
    # one row per band, fewer than 200 at 15 % edits
    an, own = ({r["band"]: r["count"] for r in d.groupBy("band").count().collect()} for d in (left, right))
    bn = {k: sum(own.get(k + s, 0) for s in (-1, 0, 1)) for k in an}
    slices = {k: (-(-an[k] // SLICE), -(-bn[k] // SLICE)) for k in an if bn[k]}
    schema = "a1 long, a2 long, b1 long, b2 long, edits int"
    if not slices:
        return left.sparkSession.createDataFrame([], schema)

    def count_of(side: int) -> Column:
        pairs = [F.lit(x) for k, n in slices.items() for x in (k, n[side])]
        return F.element_at(F.create_map(*pairs), F.col("band"))

    def every(side: int) -> Column:
        return F.explode(F.sequence(F.lit(0), count_of(side) - 1))

    blocks = min(sum(x * y for x, y in slices.values()), 2000)
    key = ["band", "a_slice", "b_slice"]
    a = left.where(F.col("band").isin(list(slices))).select("k1", "k2", "text", "band", F.pmod("k1", count_of(0)).cast("int").alias("a_slice"), every(1).alias("b_slice"))
    b = right.withColumn("band", F.explode(F.array(*[F.col("band") + s for s in (-1, 0, 1)]))).where(F.col("band").isin(list(slices)))
    b = b.select("k1", "k2", "text", "band", every(0).alias("a_slice"), F.pmod("k1", count_of(1)).cast("int").alias("b_slice"))

    shared = left.sparkSession.sparkContext.broadcast(gram_squares(left.select("text").union(right.select("text")), gram_size(max_edits)))  # CELLS numbers

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        got = list(close_pairs(list(x["text"]), list(y["text"]), max_edits, shared.value))
        i, j, e = ([g[c] for g in got] for c in range(3))
        return pd.DataFrame({"a1": x["k1"].to_numpy()[i], "a2": x["k2"].to_numpy()[i], "b1": y["k1"].to_numpy()[j], "b2": y["k2"].to_numpy()[j], "edits": e}) if got else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return a.repartition(blocks, *key).groupBy(*key).cogroup(b.repartition(blocks, *key).groupBy(*key)).applyInPandas(match, schema)


def rows_with_fold(df: DataFrame, text: str, keep: list[str], min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(rows: the kept columns and the key of the folded text; texts: (k1, k2, text) per distinct folded text), both written once.
    Rows with a null text or fewer letters and digits than min_chars fall out."""
    forms = canonical_texts(df, text).select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), folded(F.col("form")).alias("fold"))
    forms = durable(forms.where(F.length("fold") >= min_chars).select("t1", "t2", "fold", *text_key(F.col("fold"))), "folds")
    r1, r2 = text_key(F.col(text))
    rows = df.where(F.col(text).isNotNull()).select(*keep, r1.alias("t1"), r2.alias("t2")).join(forms.select("t1", "t2", "k1", "k2"), ["t1", "t2"])
    texts = forms.groupBy("k1", "k2").agg(F.first("fold").alias("text"))
    return rows.select(*keep, "k1", "k2"), texts


def _linked(train: DataFrame, dev: DataFrame, text: str, keep: list[str], max_edits: float, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train rows, dev rows, links of their texts)."""
    a_rows, a_texts = rows_with_fold(train, text, keep, min_chars)
    b_rows, b_texts = rows_with_fold(dev, text, keep, min_chars)
    return a_rows, b_rows, durable(edit_links(a_texts, b_texts, max_edits), "links")


def cross_split_pairs(train: DataFrame, dev: DataFrame, row_id: str, text: str, max_edits: float = 0.15, min_chars: int = 30) -> DataFrame:
    """(train_<row_id>, dev_<row_id>, edits): row pairs whose letters and digits, read without case and invisible differences, are
    within max_edits of the longer. Empty tables give no pair. Repeated rows are pairs of their own: `cross_split_rows` doesn't multiply
    them."""
    a_rows, b_rows, links = _linked(train, dev, text, [row_id], max_edits, min_chars)
    a = a_rows.select(F.col(row_id).alias(f"train_{row_id}"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = b_rows.select(F.col(row_id).alias(f"dev_{row_id}"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    return links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).drop("a1", "a2", "b1", "b2")


def cross_split_rows(train: DataFrame, dev: DataFrame, keep: list[str], text: str, max_edits: float = 0.15, min_chars: int = 30) -> DataFrame:
    """(split: train or dev, kept columns, class_id, n_texts, n_links): one row per row with a counterpart on the other side. Rows with the
    same folded text share a class_id; n_texts counts the linked texts of the other side, n_links their rows."""
    a_rows, b_rows, links = _linked(train, dev, text, keep, max_edits, min_chars)
    sides = []
    for split, rows, other, me, you in (("train", a_rows, b_rows, "a", "b"), ("dev", b_rows, a_rows, "b", "a")):
        copies = other.groupBy("k1", "k2").agg(F.count("*").alias("c")).toDF(f"{you}1", f"{you}2", "c")
        per = links.join(copies, [f"{you}1", f"{you}2"]).groupBy(F.col(f"{me}1").alias("k1"), F.col(f"{me}2").alias("k2")).agg(F.count("*").alias("n_texts"), F.sum("c").alias("n_links"))
        sides.append(rows.join(per, ["k1", "k2"]).select(F.lit(split).alias("split"), *keep, F.col("k1").alias("class_id"), "n_texts", "n_links"))
    return sides[0].unionByName(sides[1])
