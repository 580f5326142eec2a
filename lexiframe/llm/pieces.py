"""Problem 5: oversized items cut into pieces at natural boundaries.

Method: byte-range processing. An item is read in ranges; each range, with a halo on either side, finds its own cut: the last sentence
end in a window before the end of the range, else the last clause end, else the last blank, else the end of the window. Ranges of equal
length make the stitching a matter of their number, files get their ranges' places by a prefix sum of character counts, and pieces
are emitted by offset. A cut depends on its range alone, so a giant item is cut by as many workers as it has ranges and no one reads
it whole.

With a limit of L characters, an overlap of O that may grow by B to begin at a word, and a window of W, the ranges have L - O - B - W
characters: two neighbouring cuts are then at most L - O - B apart, and no piece is above L.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import bounded_rows
from .keys import known_seconds
from .sentences import CUT, _stages

HALO = 32  #: characters beyond a window that boundary rules may look at
SLACK = 16  #: characters an overlap may grow
FEW = 48  #: an item with fewer characters per piece than this is cut by time alone


def _with_cut(d: DataFrame, k: Column, out: str) -> DataFrame:
    """Adds the position of cut k, found in the window that ends at (k + 1) * _size. 0 for k < 0, _n where the range is the last."""
    end = (k + 1) * F.col("_size")
    at = end - F.col("_window")
    first = F.greatest(F.lit(0), at - HALO)
    d = d.withColumn("_w", F.substring("_ctx", first - F.col("_from") + 1, F.least(end + HALO, F.col("_n")) - first))
    d = _stages(d, "_w", "_m").withColumn("_u", F.split("_m", CUT))
    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("best"))

    def step(acc: Column, u: Column) -> Column:
        here = acc["at"] + F.length(u)
        ok = (first + here > at) & (first + here <= end)
        return F.struct(here.alias("at"), F.when(ok, here).otherwise(acc["best"]).alias("best"))

    # the last unit ends with the halo, not with a boundary
    ends = F.slice("_u", F.lit(1), F.greatest(F.lit(0), F.size("_u") - 1))
    d = d.withColumn("_b", F.aggregate(ends, zero, step)["best"])
    plain = F.substring("_w", at - first + 1, F.col("_window"))
    clause = F.length(F.regexp_extract(plain, r"^([\s\S]*[,;:،、]\s*)", 1))
    blank = F.length(F.regexp_extract(plain, r"^([\s\S]*\s)", 1))
    found = F.when(F.col("_b") >= 0, first + F.col("_b")).when(clause > 0, at + clause).when(blank > 0, at + blank).otherwise(end)
    return d.withColumn(out, F.when(k < 0, 0).when(end >= F.col("_n"), F.col("_n")).otherwise(found).cast("int")).drop("_w", "_m", "_u", "_b")


def _pieces(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Pieces of ranges (key, _n, _s, _k, _size, _window, _over, _slack, _from, _ctx: the text from _from to the end of the range and
    its halo)."""
    d = _with_cut(_with_cut(ranges, F.col("_k"), "_cut"), F.col("_k") - 1, "_prev")
    d = d.withColumn("_least", F.greatest(F.lit(0), F.col("_prev") - F.col("_over")))
    lead = F.greatest(F.lit(0), F.col("_least") - F.col("_slack"))
    before = F.substring("_ctx", lead - F.col("_from") + 1, F.col("_least") - lead)
    grown = F.when(before.rlike(r"\s\S*$"), F.length(F.regexp_extract(before, r"\s(\S*)$", 1))).otherwise(0)
    d = d.withColumn("_start", F.when(F.col("_prev") == 0, 0).otherwise(F.col("_least") - grown))
    per_char = F.col("_s") / F.col("_n")
    return d.select(
        *key,
        (F.col("_k") + 1).cast("int").alias("piece_no"),
        F.col("_start").cast("long").alias("start_pos"),
        F.col("_cut").cast("long").alias("end_pos"),
        F.substring("_ctx", F.col("_start") - F.col("_from") + 1, F.col("_cut") - F.col("_start")).alias("piece"),
        (F.col("_start") * per_char).alias("start_s"),
        (F.col("_cut") * per_char).alias("end_s"),
    )


def _with_sizes(d: DataFrame, limit: Column, over: Column) -> DataFrame:
    d = d.withColumn("_limit", limit.cast("int")).withColumn("_over", F.least(over, F.floor(F.col("_limit") / 2)).cast("int"))
    d = d.withColumn("_slack", F.least(F.lit(SLACK), F.floor((F.col("_limit") - F.col("_over")) / 4)).cast("int"))
    step = F.col("_limit") - F.col("_over") - F.col("_slack")
    # at most half a step, so that cuts rise from range to range
    window = F.greatest(F.floor(step / 3), F.least(F.lit(24), F.floor(step / 2)))
    d = d.withColumn("_window", F.greatest(F.lit(1), window).cast("int"))
    return d.withColumn("_size", F.greatest(F.lit(1), step - F.col("_window")).cast("int"))


def _context(k: Column) -> tuple[Column, Column]:
    """(start, end) of the text that range k needs."""
    start = F.greatest(F.lit(0), k * F.col("_size") - F.col("_window") - HALO - F.col("_over") - F.col("_slack"))
    return start, F.least(F.col("_n"), (k + 1) * F.col("_size") + HALO)


def split_oversized(items: DataFrame, key: list[str], text: str, seconds: Column | None, limits: dict) -> DataFrame:
    """Pieces of the items above a limit: key, piece_no from 1 and rising, start_pos, end_pos (code points, end exclusive), piece, start_s,
    end_s.

    limits: max_chars, overlap_chars, max_seconds, overlap_seconds; None lifts a limit. Time is taken to run evenly over the characters.
    The limit that asks for the shorter pieces rules, and its overlap holds between neighbours; it grows to begin at a word where one
    begins within SLACK characters. Items with no text, or so little that a piece would hold fewer than FEW characters, are cut by time
    alone, each piece with the words that fall into it. Unknown durations (null) limit nothing; null texts count as empty. Items
    within the limits give no rows; repeated rows give their pieces again. No shuffle takes place.
    """
    max_chars, over_chars = limits.get("max_chars"), limits.get("overlap_chars") or 0
    max_s, over_s = limits.get("max_seconds"), float(limits.get("overlap_seconds") or 0.0)
    d = items.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_t"), (F.lit(None).cast("double") if seconds is None else seconds).alias("_s"))
    d = d.withColumn("_n", F.length("_t"))
    by_chars = F.col("_n") > (max_chars if max_chars is not None else 1 << 31)
    by_time = F.lit(False) if max_s is None else F.coalesce(F.col("_s") > float(max_s), F.lit(False))
    d = d.where(by_chars | by_time).withColumn("_timed", by_time)
    per_char = F.try_divide(F.col("_s"), F.col("_n"))
    d = d.withColumn("_by_time", F.when(F.col("_timed"), F.coalesce(F.floor(F.try_divide(F.lit(float(max_s or 0)), per_char)), F.lit(0))).cast("int"))
    sparse = F.coalesce(F.col("_by_time") < FEW, F.lit(False)) & ~by_chars
    most = F.lit(max_chars if max_chars is not None else (1 << 31) - 1).cast("int")
    dense = d.where(~sparse)
    time_rules = F.coalesce(F.col("_by_time") < most, F.lit(False))
    dense = _with_sizes(dense, F.greatest(F.lit(1), F.least("_by_time", most)), F.when(time_rules, F.ceil(F.lit(over_s) / per_char)).otherwise(F.lit(int(over_chars))))
    ranges = dense.withColumn("_k", F.explode_outer(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.col("_size")).cast("int")))).where("_k is not null")
    start, end = _context(F.col("_k"))
    ranges = ranges.withColumn("_from", start.cast("int")).withColumn("_ctx", F.substring("_t", start + 1, end - start)).drop("_t")
    out = _pieces(ranges, key)
    if max_s is None:
        return out
    hop = float(max_s) - over_s
    few = d.where(sparse).withColumn("_k", F.explode_outer(F.sequence(F.lit(0), F.ceil((F.col("_s") - float(max_s)) / hop).cast("int")))).where("_k is not null")
    t0 = F.col("_k") * hop
    t1 = F.least(t0 + float(max_s), F.col("_s"))
    a, b = F.floor(t0 / F.col("_s") * F.col("_n")), F.when(t1 >= F.col("_s"), F.col("_n")).otherwise(F.floor(t1 / F.col("_s") * F.col("_n")))
    few = few.withColumn("_a", a.cast("int")).withColumn("_b", b.cast("int"))
    # whole words: the time says when, the text shows the words that are being said
    a = F.col("_a") - F.length(F.regexp_extract(F.substring("_t", F.lit(1), F.col("_a")), r"(\S*)$", 1))
    b = F.col("_b") + F.length(F.regexp_extract(F.expr("substring(_t, _b + 1)"), r"^(\S*)", 1))
    few = few.withColumn("_a2", a).withColumn("_b2", b)
    a, b = F.col("_a2"), F.col("_b2")
    few = few.select(*key, (F.col("_k") + 1).cast("int").alias("piece_no"), a.cast("long").alias("start_pos"), b.cast("long").alias("end_pos"), F.substring("_t", (a + 1).cast("int"), (b - a).cast("int")).alias("piece"), t0.alias("start_s"), t1.alias("end_s"))
    return out.unionByName(few)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def _bytes(path: str, lo: int, hi: int) -> bytes:
    at, name = _opened(path)
    with at.open_input_file(name) as f:
        f.seek(lo)
        return f.read(hi - lo)


def files_below(folder: str) -> list[str]:
    """URIs of the files of a folder that Spark has written, by name; marks of success and hidden files are left out."""
    at, name = _opened(folder)
    found = sorted(i.path for i in at.get_file_info(fs.FileSelector(name)) if i.is_file and i.size and not i.base_name.startswith(("_", ".")))
    scheme = folder.split("://")[0] if "://" in folder else "file"
    return [f"{scheme}://{p}" for p in found]


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap_chars: int = 0, range_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of giant UTF-8 files: path, piece_no, start_pos, end_pos, piece, start_s and end_s (null). Paths are URIs of any file system that
    Arrow reads by ranges (file, object stores, HDFS), or plain paths; all workers must see them.

    Workers count the characters of byte ranges; a prefix sum over the ranges places them; workers then read their range once more with
    the halo and emit the text around each cut. A file within max_chars is one piece; an empty one gives none.
    """
    sizes = []
    for p in paths:
        at, name = _opened(p)
        sizes.append((p, at.get_file_info(name).size))
    rows = [(p, r, r * range_bytes, min(size, (r + 1) * range_bytes), size) for p, size in sizes for r in range(-(-size // range_bytes))]
    ranges = spark.createDataFrame(rows, "path string, r int, lo long, hi long, size long").repartition(max(1, len(rows)), "path", "r")

    def starts(data: bytes) -> int:
        return sum(1 for b in data if b & 0xC0 != 0x80) if len(data) < 1 << 16 else len(data) - sum(data.count(bytes([b])) for b in range(0x80, 0xC0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = []
            for p, lo, hi in zip(b["path"], b["lo"], b["hi"], strict=True):
                n.append(starts(_bytes(p, lo, hi)))
            yield b.assign(chars=n)

    counted = ranges.mapInPandas(count, "path string, r int, lo long, hi long, size long, chars long")
    per_file = Window.partitionBy("path")
    placed = counted.withColumn("first", F.sum("chars").over(per_file.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")).withColumn("_n", F.sum("chars").over(per_file))
    placed = _with_sizes(placed.repartition(max(1, len(rows)), "path", "r"), F.lit(max_chars), F.lit(overlap_chars))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples():
                if not x.chars:
                    continue
                size, win, over, slack = x.size_, x.win, x.over, x.slack
                back = size + win + HALO + over + slack  # characters before the range that its first cut may need
                lo, hi = max(0, x.lo - 4 * back), min(x.size, x.hi + 4 * (size + HALO))
                data = _bytes(x.path, lo, hi)
                head, tail = data[: x.lo - lo], data[x.lo - lo :]
                while head and head[0] & 0xC0 == 0x80:
                    head = head[1:]
                cut = 0
                while cut < len(tail) and tail[cut] & 0xC0 == 0x80:
                    cut += 1  # the character that began before
                text = (head + tail[:cut]).decode(errors="replace")
                at = x.first - len(text)
                text += tail[cut:].decode(errors="ignore")
                n = x.n
                k0, k1 = -(-x.first // size), -(-(x.first + x.chars) // size)  # ranges of the grid that begin here
                out = []
                for k in range(k0, k1):
                    start = max(0, k * size - win - HALO - over - slack)
                    end = min(n, (k + 1) * size + HALO)
                    out.append((x.path, n, k, start, text[start - at : end - at]))
                yield pd.DataFrame(out, columns=["path", "_n", "_k", "_from", "_ctx"])

    named = placed.select("path", "r", "lo", "hi", "size", "chars", "first", F.col("_n").alias("n"), F.col("_size").alias("size_"), F.col("_window").alias("win"), F.col("_over").alias("over"), F.col("_slack").alias("slack"))
    ctx = named.mapInPandas(contexts, "path string, _n long, _k long, _from long, _ctx string")
    return _pieces(_with_sizes(ctx.withColumn("_s", F.lit(None).cast("double")), F.lit(max_chars), F.lit(overlap_chars)), ["path"])


def manifest_pieces(manifest: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Pieces of the manifest rows above the limits of item 'manifest', keyed by path; rows repeated in all these fields are one."""
    limits = next(r.asDict() for r in bounded_rows(size_limits, 1000, "size_limits") if r["item"] == "manifest")
    s = known_seconds(F.col("duration"))
    over = (F.length("sentence") > limits["max_chars"]) | (s > limits["max_seconds"])
    rows = manifest.where(over & F.col("path").isNotNull()).select("path", "sentence", s.alias("seconds")).distinct()
    return split_oversized(rows, ["path"], "sentence", F.col("seconds"), limits)
