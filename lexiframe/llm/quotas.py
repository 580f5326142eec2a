"""Problem 7: a sample that matches target category proportions.

Method: min-cost flow on the cross-classified cell counts. Arcs carry the margins (what each direction and each length bucket should
get), the floors of small cells and what is available; slack arcs take what can't be met and so name the shortfalls. The integer cell
quotas are then drawn at random.

The flow has one node per cell of the target table, whatever the number of calls. The draw ranks nothing as a whole: a histogram of
hashes per cell finds the bin in which the quota ends, and only that bin is ranked.
"""

from __future__ import annotations

import heapq
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded_rows
from .keys import known_call, known_seconds, plain

LEVEL = 64  #: the bin in which a quota ends is found in two steps of so many bins
MAX_CELLS = 10_000
TRANCHES = 12


class Flow:
    """Least-cost flow by successive shortest paths with potentials; capacities and costs are integers, costs not negative."""

    def __init__(self, n: int) -> None:
        self.arcs: list[list[int]] = []  # [to, left, cost]; the arc back is at index ^ 1
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, cap, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def sent(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def run(self, s: int, t: int) -> int:
        """Sends as much as fits from s to t at least cost."""
        pot, total = [0] * len(self.out), 0
        while True:
            dist, via = {s: 0}, {}
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.out[u]:
                    v, left, cost = self.arcs[k]
                    if left and d + cost + pot[u] - pot[v] < dist.get(v, 1 << 62):
                        dist[v] = d + cost + pot[u] - pot[v]
                        via[v] = k
                        heapq.heappush(heap, (dist[v], v))
            if t not in dist:
                return total
            far = max(dist.values())
            for u in range(len(pot)):
                pot[u] += dist.get(u, far)
            path, u = [], t
            while u != s:
                path.append(via[u])
                u = self.arcs[via[u] ^ 1][0]
            amount = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= amount
                self.arcs[k ^ 1][1] += amount
            total += amount


def plan_quotas(cells: list[dict]) -> list[dict]:
    """Quota and shortfall of each cell.

    cells: direction, bucket, wanted, floor, available, locked. The flow gives each cell what it wants as far as it is there; what a cell
    lacks leaves by its slack arc as the shortfall, and is refilled, in this order, from cells of the same bucket, of the same direction
    and any other, as long as they have spare calls. Locked calls are in any case.
    """
    n = len(cells)
    dirs = sorted({c["direction"] for c in cells})
    bucks = sorted({c["bucket"] for c in cells})
    names = ["source", "sink", "any", *[("dir", d) for d in dirs], *[("bucket", b) for b in bucks]]
    names += [(kind, i) for i in range(n) for kind in ("cell", "stock", "extra")]
    node = {x: i for i, x in enumerate(names)}
    f = Flow(len(names))
    want, short, extra = [], [], []
    for i, c in enumerate(cells):
        w = max(c["wanted"], c["floor"], c["locked"])
        cell, stock, more = node["cell", i], node["stock", i], node["extra", i]
        f.arc(node["source"], cell, w, 0)
        want.append(f.arc(cell, stock, c["available"], 0))
        f.arc(stock, node["sink"], c["available"], 0)
        # slack: demand the cell can't meet passes to the margins, and from there to calls that other cells have to spare
        short.append([f.arc(cell, node["bucket", c["bucket"]], w, 100), f.arc(cell, node["dir", c["direction"]], w, 200), f.arc(cell, node["any"], w, 300)])
        for margin in (("bucket", c["bucket"]), ("dir", c["direction"]), "any"):
            f.arc(node[margin], more, c["available"], 0)
        # the cost rises with the share that a cell is overdrawn, so that refills spread in proportion
        tranche = max(1, -(-w // TRANCHES))
        extra.append([f.arc(more, stock, tranche if k < TRANCHES else c["available"], k) for k in range(1, TRANCHES + 1)])
    f.arc(node["any"], node["sink"], 1 << 40, 100_000)  # what no cell can give
    f.run(node["source"], node["sink"])
    out = []
    for i, c in enumerate(cells):
        wanted = max(c["wanted"], c["floor"])
        slack = sum(f.sent(k) for k in short[i])
        refilled = sum(f.sent(k) for k in extra[i])
        own = f.sent(want[i])
        out.append(c | {"wanted": wanted, "shortfall": max(0, wanted - own) if slack else 0, "quota": own + refilled, "refilled": refilled})
    return out


def fitted(cells: list[dict], size: int) -> list[dict]:
    """Quotas that sum up to the size of the sample where floors and locked calls have made them exceed it: what a cell has above its floor
    is given up in proportion, by a flow that brings the size's calls to the cells at a cost that rises with the share of a cell that is
    filled. Floors and locked calls stand, even beyond the size. Adds given_up."""
    least = [max(min(c["floor"], c["quota"]), min(c["locked"], c["quota"])) for c in cells]
    spare = [c["quota"] - m for c, m in zip(cells, least, strict=True)]
    if sum(least) + sum(spare) <= size:
        return [c | {"given_up": 0} for c in cells]
    f = Flow(len(cells) + 3)
    source, hub, sink = len(cells), len(cells) + 1, len(cells) + 2
    f.arc(source, hub, max(0, size - sum(least)), 0)
    taken = []
    for i, s in enumerate(spare):
        edges = [s * k // TRANCHES for k in range(TRANCHES + 1)]
        taken.append([f.arc(hub, i, b - a, k) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a])
        f.arc(i, sink, s, 0)
    f.run(source, sink)
    quotas = [m + sum(f.sent(k) for k in arcs) for m, arcs in zip(least, taken, strict=True)]
    return [c | {"quota": q, "given_up": c["quota"] - q} for c, q in zip(cells, quotas, strict=True)]


def call_table(manifest: DataFrame) -> DataFrame:
    """(call_id, direction, seconds): one row per call. Rows of one path count once; direction is null if no row gives one, the smallest
    by name if rows disagree; unknown durations count as 0. Rows without a call are left out."""
    call = known_call(F.col("call_id"), F.col("path")).alias("call_id")
    paths = manifest.select(call, "path", plain(F.col("direction")).alias("direction"), known_seconds(F.col("duration")).alias("s")).where("call_id is not null")
    paths = paths.groupBy("call_id", "path").agg(F.max("s").alias("s"), F.min("direction").alias("direction"))
    return paths.groupBy("call_id").agg(F.min("direction").alias("direction"), F.round(F.coalesce(F.sum(F.col("s").cast("decimal(18,6)")), F.lit(0)), 2).cast("double").alias("seconds"))


def _cell(targets: list[dict]) -> Column:
    """Index of the target row that a call belongs to; null if none."""
    c = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(targets))):
        high = F.lit(True) if t["max_seconds"] is None else F.col("seconds") < t["max_seconds"]
        c = F.when((F.coalesce(F.col("direction"), F.lit("?")) == t["direction"]) & (F.col("seconds") >= t["min_seconds"]) & high, i).otherwise(c)
    return c


def _prepare(manifest: DataFrame, targets: DataFrame, locked: DataFrame, share: float) -> tuple[DataFrame, list[dict], int]:
    t = [r.asDict() for r in bounded_rows(targets, MAX_CELLS, "sample_targets")]
    t.sort(key=lambda r: (r["direction"], r["bucket"]))
    keep = locked.where("locked").select("call_id").where("call_id is not null").distinct().withColumn("locked", F.lit(True))
    calls = call_table(manifest).join(keep, "call_id", "left")
    calls = calls.select("call_id", "direction", "seconds", F.coalesce("locked", F.lit(False)).alias("locked"), _cell(t).alias("cell"))
    counts = {r["cell"]: r for r in calls.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("locked").alias("l")).collect()}  # one row per cell
    size = floor(sum(r["n"] for r in counts.values()) * share)
    for i, r in enumerate(t):
        got = counts.get(i)
        r |= {"cell": i, "wanted": floor(r["per_mille"] * size / 1000), "floor": r["min_calls"] or 0, "available": got["n"] if got else 0, "locked": got["l"] if got else 0}
    return calls, fitted(plan_quotas(t), size), size


def stratum_report(manifest: DataFrame, targets: DataFrame, locked: DataFrame, share: float = 0.1) -> DataFrame:
    """One row per target: wanted, available, locked, quota, refilled (calls taken for other strata), given_up (calls left
    out because floors elsewhere fill the sample) and shortfall."""
    _, plan, _ = _prepare(manifest, targets, locked, share)
    names = ["direction", "bucket", "wanted", "available", "locked", "quota", "refilled", "given_up", "shortfall"]
    schema = "direction string, bucket string, wanted long, available long, locked long, quota long, refilled long, given_up long, shortfall long"
    return manifest.sparkSession.createDataFrame([tuple(p[k] for k in names) for p in plan], schema)


def _end_bins(free: DataFrame, left: dict[int, int]) -> dict[int, int]:
    """The bin of each cell in which what is left of its quota ends, LEVEL bins a cell at most; left is reduced by the bins before. LEVEL²
    where a cell's rows don't exceed its quota; a cell without rows isn't there."""
    hist: dict[int, dict[int, int]] = {}
    for r in free.groupBy("cell", "bin").agg(F.count("*").alias("n")).collect():  # at most LEVEL rows a cell
        hist.setdefault(r["cell"], {})[r["bin"]] = r["n"]
    out = {}
    for cell, bins in hist.items():
        for b in sorted(bins):
            if bins[b] > left[cell]:
                out[cell] = b
                break
            left[cell] -= bins[b]
        else:
            out[cell] = LEVEL**2  # beyond all
    return out


def draw_sample(manifest: DataFrame, targets: DataFrame, locked: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """(call_id, direction, bucket, locked): the sample. Ties of the random order go by call_id. A locked call is in it even if its
    stratum is no target (bucket null); one that manifest doesn't hold can't be."""
    calls, plan, _ = _prepare(manifest, targets, locked, share)
    spark = manifest.sparkSession
    h = F.pmod(F.xxhash64("call_id", F.lit(seed)), F.lit(1 << 40))
    free = calls.where("not locked and cell is not null").select("call_id", "cell", h.alias("h"), F.floor(h / F.lit((1 << 40) // LEVEL**2)).cast("int").alias("bin"))
    left = {p["cell"]: max(0, p["quota"] - p["locked"]) for p in plan}
    at = _end_bins(free.select("cell", F.floor(F.col("bin") / LEVEL).cast("int").alias("bin")), left)
    first = F.broadcast(spark.createDataFrame(list(at.items()), "cell int, first int"))
    inner = free.join(first, "cell").where(F.floor(F.col("bin") / LEVEL) == F.col("first")).select("cell", "bin")
    end = _end_bins(inner, left)
    rows = [(c, end.get(c, LEVEL**2), left[c] if c in end else 0) for c in at]
    cut = F.broadcast(spark.createDataFrame(rows, "cell int, last_bin int, rest int"))
    marked = free.join(cut, "cell")
    whole = marked.where("bin < last_bin").select("call_id")
    edge = marked.where("bin = last_bin and rest > 0").withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("h", "call_id")))
    chosen = whole.union(edge.where("k <= rest").select("call_id")).union(calls.where("locked").select("call_id"))
    names = F.broadcast(spark.createDataFrame([(p["cell"], p["bucket"]) for p in plan], "cell int, bucket string"))
    return calls.join(chosen, "call_id", "left_semi").join(names, "cell", "left").select("call_id", F.coalesce("direction", F.lit("?")).alias("direction"), "bucket", "locked")
