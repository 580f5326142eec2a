"""Problem 8: filling containers of fixed capacity.

Method: optimal length buckets. Dynamic programming over the global histogram of sizes chooses bucket boundaries that minimise padding
(the room an item leaves in a slot of its bucket's size); token-budget batches are then formed from the buckets.

Batches inside one bucket alone would leave the remainder of capacity / slot empty, up to half of a container. So a batch starts in the
largest bucket that has items left and its remaining budget is given to the largest smaller buckets that fit. The planning
sees bucket counts only; items get their container by their rank in the bucket, which is an offset per sub-bucket plus a rank in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded_rows, durable

BUCKETS = 64
BINS = 1 << 15  #: the histogram is kept this fine; larger capacities are rounded up to so many steps
SUB = 50_000  #: items per sub-bucket that are ranked together
#: Fixed value: what a byte-level tokenizer adds to the bytes of a text.
END_MARKS = 1


def byte_tokens(text: Column) -> Column:
    """Size of a text for a byte-level tokenizer: its UTF-8 bytes and one end mark. A null text counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + END_MARKS


def optimal_buckets(sizes: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Upper bounds of at most k buckets over rising sizes with the least total padding. O(k n log n) by the monotonicity of the cuts."""
    n = len(sizes)
    if n <= k:
        return [int(s) for s in sizes]
    c = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    m = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float)
    # cost of one bucket over i..j-1: sizes[j-1] * count - mass
    best = np.concatenate([[0.0], sizes * c[1:] - m[1:]])
    cuts = [np.zeros(n + 1, int)]
    for _ in range(1, k):
        nxt, cut = best.copy(), np.zeros(n + 1, int)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + sizes[j - 1] * (c[j] - c[i]) - (m[j] - m[i])
            at = int(np.argmin(total))
            nxt[j], cut[j] = total[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        best = nxt
        cuts.append(cut)
    bounds, j = [], n
    for layer in reversed(cuts):
        bounds.append(int(sizes[j - 1]))
        j = int(layer[j])
        if j == 0:
            break
    return sorted(bounds)


def plan_batches(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(bucket, first rank, items per container, first container, ...) rows of the plan, as (bucket, rank0, mult, container0) with the
    number of containers given by the next row of the bucket. Greedy by falling size on counts: one pattern is used as often as its
    buckets last, so the plan has at most a few rows per bucket."""
    left = list(counts)
    rank = [0] * len(bounds)
    rows, container = [], 0
    order = sorted(range(len(bounds)), key=lambda b: -bounds[b])
    while any(left):
        room, pattern = capacity, {}
        for b in order:
            take = min(left[b], room // bounds[b])
            if take:
                pattern[b] = take
                room -= take * bounds[b]
        times = min(left[b] // t for b, t in pattern.items())
        for b, t in pattern.items():
            rows.append((b, rank[b], t, container))
            rank[b] += times * t
            left[b] -= times * t
        container += times
    return rows


def cut_points(data: bytes, most: int) -> list[tuple[int, int]]:
    """Byte spans of at most `most` bytes that part no code point."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end))
        at = end
    return out


def _items(docs: DataFrame, doc_id: str, text: str, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start_byte, tokens): whole documents within the capacity, and the pieces of larger ones."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), byte_tokens(F.col(text)).alias("tokens"), F.col(text).alias("_t"))
    whole = sized.where(F.col("tokens") <= capacity).select("doc_id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("start_byte"), "tokens")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["_t"], strict=True):
                out += [(d, i, s, e - s + END_MARKS) for i, (s, e) in enumerate(cut_points(t.encode(), capacity - END_MARKS), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "piece_no", "start_byte", "tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    large = sized.where(F.col("tokens") > capacity).select("doc_id", "_t").mapInPandas(cut, f"doc_id {kind}, piece_no int, start_byte long, tokens long")
    return whole.unionByName(large)


def fill_containers(docs: DataFrame, doc_id: str, text: str, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, piece_no, start_byte, tokens, container): every document once, cut only if it alone exceeds the capacity; the tokens of a
    container never exceed it. Empty and null texts take the end mark's room. Documents repeated with one id are items of their own as
    long as their piece_no or size differs in rank; equal ones share the order. No documents give no rows.
    """
    if capacity <= END_MARKS + 4:
        raise ValueError("the capacity must hold a character and the end mark")
    grain = max(1, -(-capacity // BINS))
    items = durable(_items(docs, doc_id, text, capacity), "items")  # the texts are read once
    slot = F.least(F.ceil(F.col("tokens") / grain) * grain, F.lit(capacity)).cast("long")
    hist = items.groupBy(slot.alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()  # at most BINS rows
    if not hist:
        return items.withColumn("container", F.lit(0).cast("long"))
    sizes, counts = np.array([r["size"] for r in hist]), np.array([r["n"] for r in hist])
    bounds = optimal_buckets(sizes, counts, buckets)
    index = np.searchsorted(bounds, sizes)
    per = np.bincount(index, counts, minlength=len(bounds)).astype(int)
    plan = plan_batches(bounds, [int(x) for x in per], capacity)
    bucket = F.lit(len(bounds) - 1)
    for b in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("tokens") <= bounds[b], b).otherwise(bucket)
    subs = max(1, int(counts.sum()) // SUB)
    named = items.withColumn("bucket", bucket).withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(subs)).cast("int"))
    sub_counts = named.groupBy("bucket", "sub").agg(F.count("*").alias("n"))
    offset = Window.partitionBy("bucket").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sub_counts.select("bucket", "sub", F.coalesce(F.sum("n").over(offset), F.lit(0)).alias("base"))
    ranked = named.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "sub").orderBy("doc_id", "piece_no", "tokens")) - 1)
    ranked = ranked.join(offsets, ["bucket", "sub"]).withColumn("rank", F.col("base") + F.col("rn"))
    spark = docs.sparkSession
    table: dict[int, list[tuple[int, int, int]]] = {}
    for b, r, t, c in plan:
        table.setdefault(b, []).append((r, t, c))
    recipes = F.broadcast(spark.createDataFrame([(b, rows) for b, rows in table.items()], "bucket int, rows array<struct<r: long, t: long, c: long>>"))  # one row per bucket
    mine = F.element_at(F.filter("rows", lambda x: x["r"] <= F.col("rank")), -1)
    placed = ranked.join(recipes, "bucket").withColumn("x", mine)
    return placed.select("doc_id", "piece_no", "start_byte", "tokens", (F.col("x.c") + F.floor((F.col("rank") - F.col("x.r")) / F.col("x.t"))).cast("long").alias("container"))


def capacity_of(size_limits: DataFrame, item: str) -> int:
    return next(int(r["max_tokens"]) for r in bounded_rows(size_limits, 1000, "size_limits") if r["item"] == item)
