"""Problem 10: text that was decoded with the wrong character encoding.

Method: expectation-maximisation with latent encoding chains. Each line with characters beyond ASCII has a latent chain: none, or bytes
of one encoding read as another, once or twice. The likelihood of a chain is that of the repaired line under a character model of the
corpus; the prior of a chain is shared by the lines of one source and field, so that weak evidence of many records adds up. Lines are
repaired by their posterior.

The character model is a table of fixed size (hashed bigrams of small letters, a case model, single characters), counted over all lines
that aren't mostly UTF-8 read as another encoding. Lines travel without their text after scoring, and only their chains within PRUNE nats of the line as it
stands: below that a posterior is zero for any prior the smoothing allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

CELLS = 1 << 20
CLASSES = 0x3200
MU = 4.0
PRUNE = 30.0
PARTIAL = 3.0  #: nats a chain loses that repairs a line in part
STEP = 500  #: lines scored together
SPREAD = 20_000  #: lines of a scoring task
IMPOSSIBLE = -1e6  #: gain of a chain that can't have made a line
ALPHA = 20.0  #: pseudo-lines with the corpus-wide prior in each source and field
ROUNDS = 3
LOST = "lost"  #: chain of a line with replacement characters: certain, and beyond repair
# Encodings that bytes may have had (RIGHT) and that they may have been read as (WRONG).
UTF8_READ_AS = ("cp1252", "cp1251", "cp866", "cp437", "koi8-r", "mac-roman", "cp850", "cp1254", "cp1250", "mac-cyrillic", "gbk", "cp932")
SINGLE = ("cp1252", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "iso8859-5", "cp1254", "cp1250", "mac-cyrillic")
MULTI = ("gbk", "cp932", "euc_jp", "big5", "euc_kr")


@lru_cache(None)
def high_chars(enc: str) -> dict[str, int]:
    """Characters that an encoding shows for the bytes from 0x80; undefined bytes show as controls, and for cp1252 all controls may."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if enc in ("cp1252", "cp1254", "cp1250") else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(enc)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _cls(chars: dict[str, int], lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in chars.items() if lo <= b <= hi) + "]"


@lru_cache(None)
def utf8_runs(enc: str) -> re.Pattern:
    """Sequences that are UTF-8 bytes shown in a single-byte encoding."""
    c = high_chars(enc)
    cont = _cls(c, 0x80, 0xBF)
    return re.compile(f"(?:{_cls(c, 0xC2, 0xDF)}{cont}|{_cls(c, 0xE0, 0xEF)}{cont}{{2}}|{_cls(c, 0xF0, 0xF4)}{cont}{{3}})+")


def undo_utf8(line: str, enc: str) -> str | None:
    """The line with its UTF-8 runs read as such; None if it has none."""
    if enc in MULTI:
        try:
            got = line.encode(enc).decode("utf-8")
        except UnicodeError:
            return None
        return got if got != line else None
    runs = utf8_runs(enc)
    if not runs.search(line):
        return None
    c = high_chars(enc)

    def put(m: re.Match) -> str:
        try:
            return bytes(c[x] for x in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    got = runs.sub(put, line)
    return got if got != line else None


@lru_cache(None)
def _swap(right: str, wrong: str) -> tuple[frozenset, dict[int, str]]:
    """(characters that the wrong encoding can show, what each would have been)."""
    table = {}
    for ch, b in high_chars(wrong).items():
        try:
            table[ord(ch)] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            pass
    return frozenset(chr(x) for x in table), table


def chain_names() -> list[str]:
    one = [f"utf-8>{w}" for w in UTF8_READ_AS] + [f"utf-8>{w}>utf-8>{w}" for w in ("cp1252", "cp1251")]
    return one + [f"{r}>{w}" for r in SINGLE for w in SINGLE if r != w] + [f"{m}>{w}" for m in MULTI for w in ("cp1252", "cp1251", "koi8-r")] + [LOST]


def repaired(line: str, chain: str) -> str | None:
    """The line before the chain garbled it; None if the chain can't have."""
    steps = chain.split(">")
    if chain == LOST:
        return None
    for right, wrong in reversed(list(zip(steps[::2], steps[1::2], strict=True))):
        if right == "utf-8":
            line = undo_utf8(line, wrong)
            if line is None:
                return None
        elif right in MULTI:
            c = high_chars(wrong)
            try:
                line = bytes(b if ch >= "\x80" and (b := c[ch]) is not None else ord(ch) for ch in line).decode(right)
            except (KeyError, UnicodeDecodeError):
                return None
        else:
            can, table = _swap(right, wrong)
            if any(ch >= "\x80" and ch not in can for ch in line):
                return None
            line = line.translate(table)
    return line


@lru_cache(None)
def _single_chains() -> list[tuple[str, str]]:
    """(right, wrong) pairs of single-byte encodings."""
    return [(r, w) for r in SINGLE for w in SINGLE if r != w]


_PAIR = re.compile(r"[^\x00-\x7f]{2}")


def run_alternatives(line: str) -> list[tuple[str, str]]:
    """(chain, repaired line) of the chains with multi-byte encodings that fit a line."""
    out = []
    for w in UTF8_READ_AS:
        got = undo_utf8(line, w)
        if got is not None:
            out.append((f"utf-8>{w}", got))
            if w in ("cp1252", "cp1251"):
                again = undo_utf8(got, w)
                if again is not None:
                    out.append((f"utf-8>{w}>utf-8>{w}", again))
    if _PAIR.search(line):
        for w in ("cp1252", "cp1251", "koi8-r"):
            c = high_chars(w)
            try:
                data = bytes(c[ch] if ch >= "\x80" else ord(ch) for ch in line)
            except KeyError:
                continue
            for m in MULTI:
                try:
                    out.append((f"{m}>{w}", data.decode(m)))
                except UnicodeDecodeError:
                    pass
    return out


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, classes, case states, line ends) of lines, each closed by a line feed."""
    raw = _raw(lines)
    return *_kinds(raw), np.flatnonzero(raw == 10)


def _raw(lines: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(small letters, classes, case states) of code points."""
    low = _lower()[np.minimum(raw, 0xFFFF)]
    up = (low != raw) & (raw < 0x10000)
    letter = _letter()[np.minimum(raw, 0xFFFF)]
    case = np.where(up, 2, np.where(letter, 1, 0))
    low = np.where(raw < 0x10000, low, raw)
    cls = np.where(low < 0x3100, low, 0x3100 + np.minimum(low >> 8, 0xFF) * (low < 0x10000))
    return low, cls, case


@lru_cache(None)
def _lower() -> np.ndarray:
    return np.array([ord(x) if len(x := chr(c).lower()) == 1 and ord(x) < 0x10000 else c for c in range(0x10000)], np.int64)


@lru_cache(None)
def _letter() -> np.ndarray:
    return np.array([chr(c).islower() for c in range(0x10000)], bool)


@lru_cache(None)
def _shown() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each character that ASCII or a wrong encoding shows, -1 for others; what each pair of single-byte encodings makes of a row,
    -1 if it can't have shown it; a signature of that)."""
    chars = sorted(set(range(0x80)) | {ord(ch) for w in SINGLE for ch in high_chars(w)})
    row = np.full(0x10000, -1, np.int64)
    row[chars] = np.arange(len(chars))
    to = np.full((len(chars), len(_single_chains())), -1, np.int64)
    to[:0x80] = np.arange(0x80)[:, None]
    for k, (r, w) in enumerate(_single_chains()):
        for cp, ch in _swap(r, w)[1].items():
            to[row[cp], k] = ord(ch)
    with np.errstate(over="ignore"):
        sign = (to + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (np.array(chars, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]
        sign = (sign ^ sign >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    own = to == np.array(chars)[:, None]
    return row, to, np.where(own, np.uint64(0), sign ^ sign >> np.uint64(32))  # zero for a character that stays


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 2654435761 + b * 40503 + (a * b) * 97) % CELLS


def _mostly_runs(line: str) -> bool:
    """True if replacement characters are in the line, or UTF-8 read as another encoding makes up most of what it has beyond ASCII."""
    if "�" in line:
        return True
    high = sum(ch >= "\x80" for ch in line)
    return any(sum(len(r.group()) for r in utf8_runs(w).finditer(line)) > 0.6 * high for w in UTF8_READ_AS if w not in MULTI)


class Model:
    """Log-likelihood of lines from the counts of bigrams, classes, characters and case changes."""

    def __init__(self, pairs: np.ndarray, ones: np.ndarray, chars: np.ndarray, cases: np.ndarray) -> None:
        self.pairs, self.ones = pairs.astype(np.float32), ones.astype(np.float32)
        total = max(ones.sum(), 1.0)
        self.uni = ((ones + 0.01) / (total + 0.01 * len(ones))).astype(np.float32)
        size = np.bincount(_class_of(), chars + 0.3, minlength=CLASSES)
        self.within = np.log((chars + 0.3) / size[_class_of()]).astype(np.float32)
        c = cases.reshape(3, 3) + 1.0
        self.case = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)

    def pair_scores(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
        """Log-probability of characters b behind characters a, both as small letters, classes and case states."""
        p = (self.pairs[_cells(a[1], b[1])] + MU * self.uni[b[1]]) / (self.ones[a[1]] + MU)
        return np.log(p) + self.within[np.minimum(b[0], 0xFFFF)] + self.case[a[2], b[2]]

    def swaps(self, lines: list[str]) -> list[list[tuple[int, float]]]:
        """For each line the pairs of single-byte encodings that can have garbled it and gain more than -PRUNE, with their gains. A swap
        keeps the length of a line, so only pairs of characters with one beyond ASCII can change; each distinct one is scored once."""
        row_of, to, sign = _shown()
        out: list[list[tuple[int, float]]] = [[] for _ in lines]
        raw = _raw(lines)
        owner = np.cumsum(raw == 10) - (raw == 10)
        row = np.where(raw < 0x10000, row_of[np.minimum(raw, 0xFFFF)], -1)
        fits = np.bincount(owner, row < 0, minlength=len(lines)) == 0
        before = np.concatenate([[10], raw[:-1]])
        at = np.flatnonzero(((raw >= 0x80) | (before >= 0x80)) & fits[owner])
        if not len(at):
            return out
        keys, code = np.unique(before[at] << 16 | raw[at], return_inverse=True)
        a, b = keys >> 16, keys & 0xFFFF
        here = self.pair_scores(_kinds(a), _kinds(b))
        ya, yb = to[row_of[a]], to[row_of[b]]
        there = self.pair_scores(_kinds(np.maximum(ya, 0)), _kinds(np.maximum(yb, 0)))
        gains = np.where((ya < 0) | (yb < 0), IMPOSSIBLE, there - here[:, None]).astype(np.float32)
        for lo in range(0, len(lines), STEP):
            p, q = np.searchsorted(owner[at], [lo, lo + STEP])
            if p == q:
                continue
            mine, starts = np.unique(owner[at[p:q]], return_index=True)
            gain = np.add.reduceat(gains[code[p:q]], starts, axis=0)
            sig = np.add.reduceat(sign[row[at[p:q]]], starts, axis=0)
            i, k = np.nonzero((gain > -PRUNE) & (sig != 0))  # a line that stays as it is needs no chain
            order = np.lexsort((k, sig[i, k], i))
            i, k = i[order], k[order]
            s = sig[i, k]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1])  # chains that differ elsewhere only are the same to this line
            for x, c, g in zip(mine[i[new]].tolist(), k[new].tolist(), gain[i, k][new].tolist(), strict=True):
                out[x].append((c, g))
        return out

    def score(self, lines: list[str]) -> np.ndarray:
        if not lines:
            return np.zeros(0)
        low, cls, case, ends = _codes(lines)
        s = self.pair_scores((low[:-1], cls[:-1], case[:-1]), (low[1:], cls[1:], case[1:]))
        cum = np.concatenate([[0.0], np.cumsum(s, dtype=np.float64)])
        # the line feed that closes a line is predicted; the first character follows the line feed before it
        first = np.concatenate([[0], ends[:-1]])
        out = cum[ends] - cum[first]
        if lines[0]:
            out[0] += float(np.log(self.uni[cls[0]]))
        return out


@lru_cache(None)
def _class_of() -> np.ndarray:
    c = np.arange(0x10000)
    return np.where(c < 0x3100, c, 0x3100 + (c >> 8))


def _lines(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, line_no from 0, source, field, line): lines with characters beyond ASCII."""
    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_no", "line"))
    field = F.when(F.col("line").startswith("    "), "message").when(F.col("line").rlike(r"^(commit|Merge|Author|Date)\b"), "header").otherwise("diff")
    return d.where(F.col("line").rlike(r"[^\x00-\x7f]")).select("doc_id", "line_no", "source", field.alias("field"), "line")


def train_model(lines: DataFrame) -> Model:
    """Counts over all lines but those that are mostly UTF-8 read as another encoding or hold replacement characters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, ones, chars, cases = np.zeros(CELLS), np.zeros(CLASSES), np.zeros(0x10000), np.zeros(9)
        for b in batches:
            clean = [x for x in b["line"] if not _mostly_runs(x)]
            if not clean:
                continue
            low, cls, case, _ = _codes(clean)
            pairs += np.bincount(_cells(cls[:-1], cls[1:]), minlength=CELLS)
            ones += np.bincount(cls, minlength=CLASSES)
            chars += np.bincount(np.minimum(low, 0xFFFF), minlength=0x10000)
            cases += np.bincount(case[:-1] * 3 + case[1:], minlength=9)
        for kind, x in enumerate((pairs, ones, chars, cases)):
            at = np.flatnonzero(x)
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "i": at.astype(np.int64), "n": x[at]})

    got = lines.select("line").mapInPandas(count, "kind int, i long, n double").groupBy("kind", "i").agg(F.sum("n").alias("n")).toPandas()  # tables of fixed size
    out = []
    for kind, size in enumerate((CELLS, CLASSES, 0x10000, 9)):
        x = np.zeros(size)
        part = got[got["kind"] == kind]
        x[part["i"].to_numpy(np.int64)] = part["n"].to_numpy()
        out.append(x)
    return Model(*out)


def score_lines(lines: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line_no, source, field, n, alts): the chains of a line with their gain in log-likelihood over the line as it stands; and
    rows with a null doc_id that count, in n, the lines of a source and field without chains."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    names = {c: i for i, c in enumerate(chain_names())}
    kind = lines.schema["doc_id"].dataType.simpleString()

    def chains_of(m: Model, part: list[str]) -> list[list[tuple[int, float]]]:
        """All chains of each line within PRUNE by the full score; of chains with the same repair the first named."""
        out: list[list[tuple[int, float]]] = []
        cands: list[list[tuple[str, str]]] = []
        for x, swaps in zip(part, m.swaps(part), strict=True):
            seen, mine = {x}, []
            for chain, y in run_alternatives(x):
                if y not in seen:
                    seen.add(y)
                    mine.append((chain, y))
            cands.append(mine)
            row = []
            for k, gain in swaps:
                r, w = _single_chains()[k]
                if not mine or x.translate(_swap(r, w)[1]) not in seen:
                    row.append((names[f"{r}>{w}"], gain))
            out.append(row)
        some = [i for i, c in enumerate(cands) if c]
        for lo in range(0, len(some), STEP):
            now = some[lo : lo + STEP]
            base = m.score(["", *[part[i] for i in now]])[1:]
            got = iter(m.score(["", *[y for i in now for _, y in cands[i]]])[1:])
            for i, was in zip(now, base, strict=True):
                for chain, y in cands[i]:
                    gain = float(next(got) - was)
                    # a chain that leaves some of the line's characters beyond ASCII as they are explains only a part of the line
                    if chain.startswith("utf-8") and {ch for ch in part[i] if ch >= "\x80"} & set(y):
                        gain -= PARTIAL
                    if gain > -PRUNE:
                        out[i].append((names[chain], gain))
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            plain: dict[tuple, int] = {}
            out: list[tuple] = []
            lines_ = list(b["line"])
            clean = [i for i, x in enumerate(lines_) if "�" not in x]
            found = dict(zip(clean, chains_of(m, [lines_[i] for i in clean]), strict=True)) if clean else {}
            for i, (d, k, s, f) in enumerate(zip(b["doc_id"], b["line_no"], b["source"], b["field"], strict=True)):
                if i not in found:
                    out.append((d, k, s, f, 1, [(names[LOST], 1000.0)]))
                elif found[i]:
                    out.append((d, k, s, f, 1, found[i]))
                else:
                    plain[s, f] = plain.get((s, f), 0) + 1
            out += [(None, -1, s, f, n, None) for (s, f), n in plain.items()]
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "source", "field", "n", "alts"])

    spread = max(lines.sparkSession.sparkContext.defaultParallelism, lines.count() // SPREAD)  # scoring costs far more than reading
    return lines.repartition(spread).mapInPandas(work, f"doc_id {kind}, line_no int, source string, field string, n long, alts array<struct<chain: int, gain: double>>")


def posterior_lines(scored: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, line_no, source, field, chain, gain, posterior, p): the likeliest chain of each line with chains, its posterior, and p, the
    posterior of any chain. Priors of a source and field are re-estimated `rounds` times: one row per source and field with a map of its
    chains is joined to the lines, so that their number has no bound, and sums are partial before they are shuffled. Lines stay whole
    throughout; ties go to the chain named first."""
    names = chain_names()
    sizes = durable(scored.groupBy("source", "field").agg(F.sum("n").alias("lines")), "sizes")
    total = sizes.agg(F.sum("lines")).first()[0] or 0
    some = scored.where("doc_id is not null")
    overall = [1e-3] * len(names)
    priors = None
    for _ in range(rounds):
        flat = _responsibilities(some, priors, overall).select("source", "field", F.explode_outer("post").alias("x")).where("x is not null")
        got = durable(flat.groupBy("source", "field", "x.chain").agg(F.sum("x.r").alias("r")), "priors")
        sums = {r["chain"]: r["r"] for r in got.groupBy("chain").agg(F.sum("r").alias("r")).collect()}  # one row per chain
        overall = [(sums.get(i, 0.0) + 0.01) / (total + 1.0) for i in range(len(names))]
        maps = got.groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "r"))).alias("m"))
        priors = maps.join(sizes, ["source", "field"])
    last = _responsibilities(some, priors, overall)
    best = F.array_max(F.transform("post", lambda x: F.struct(x["r"].alias("r"), (-x["chain"]).alias("back"), x["gain"].alias("gain"))))
    out = last.select("doc_id", "line_no", "source", "field", best.alias("b"), F.aggregate("post", F.lit(0.0), lambda acc, x: acc + x["r"]).alias("p"))
    name = F.element_at(F.array(*[F.lit(x) for x in names]), 1 - F.col("b.back"))
    return out.select("doc_id", "line_no", "source", "field", name.alias("chain"), F.col("b.gain").alias("gain"), F.col("b.r").alias("posterior"), "p")


def _responsibilities(some: DataFrame, priors: DataFrame | None, overall: list[float]) -> DataFrame:
    """Adds post, array<struct<chain, gain, r>>: the posterior of each chain of each line."""
    base = F.array(*[F.lit(x) for x in overall])
    if priors is None:
        d = some.withColumn("m", F.expr("cast(null as map<int, double>)")).withColumn("lines", F.lit(0).cast("long"))
    else:
        d = some.join(priors, ["source", "field"], "left")
    known = F.coalesce("lines", F.lit(0))

    def weigh(a: Column) -> Column:
        own = F.coalesce(F.element_at("m", a["chain"]), F.lit(0.0))
        pi = (own + ALPHA * F.element_at("base", a["chain"] + 1)) / (known + ALPHA)
        return F.struct(a["chain"].alias("chain"), a["gain"].alias("gain"), pi.alias("pi"), (pi * F.exp(F.least(a["gain"], F.lit(500.0)))).alias("w"))

    d = d.withColumn("base", base).withColumn("ws", F.transform("alts", weigh))
    d = d.withColumn("sum", F.aggregate("ws", F.lit(0.0), lambda acc, x: acc + x["w"])).withColumn("none", F.greatest(F.lit(1e-6), 1 - F.aggregate("ws", F.lit(0.0), lambda acc, x: acc + x["pi"])))
    post = F.transform("ws", lambda x: F.struct(x["chain"].alias("chain"), x["gain"].alias("gain"), (x["w"] / (F.col("sum") + F.col("none"))).alias("r")))
    return d.select("doc_id", "line_no", "source", "field", post.alias("post"))


def garbled_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lines with characters beyond ASCII as read, posterior of those with chains)."""
    lines = durable(_lines(docs, doc_id, text, source), "lines")
    model = train_model(lines)
    return lines, posterior_lines(durable(score_lines(lines, model), "scored"))


def garbled_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id): documents with a line whose posterior of having been garbled is above a half, or with replacement characters. Null and
    empty texts are clean."""
    _, post = garbled_lines(docs, doc_id, text, source)
    return post.where("p > 0.5").select("doc_id").distinct()


def repaired_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, text, n_garbled, n_restored): the garbled documents with each restorable line replaced by its likeliest original; lines
    with replacement characters stay as they are."""
    lines, post = garbled_lines(docs, doc_id, text, source)
    bad = post.where("p > 0.5").join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"])

    @F.pandas_udf("string")
    def repair(line: pd.Series, chain: pd.Series) -> pd.Series:
        return pd.Series([repaired(x, c) for x, c in zip(line, chain, strict=True)], dtype=object)

    fixed = bad.select("doc_id", "line_no", repair("line", "chain").alias("fixed"))
    per = fixed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "fixed"))).alias("m"), F.count("*").alias("n_garbled"), F.count("fixed").alias("n_restored"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).join(per, "doc_id")
    whole = F.array_join(F.transform(F.split("_t", "\n"), lambda x, i: F.coalesce(F.element_at("m", i), x)), "\n")
    return d.select("doc_id", whole.alias("text"), "n_garbled", "n_restored")
