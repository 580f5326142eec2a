"""Inputs that several queries share, in Spark and in SQL.

Hypotheses aren't among the tables; two synthetic recognisers stand in for them. Of the words of a reference, run a drops every word
whose index is 3 modulo 7 and writes an x behind those at 2 modulo 5; run b drops 4 modulo 9 and marks 1 modulo 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import call_id_of, words

RUNS = {"a": (7, 3, 5, 2), "b": (9, 4, 4, 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hypothesis(ref: Column, run: str) -> Column:
    a, b, c, d = RUNS[run]
    marked = F.transform(ref, lambda w, i: F.when(i % c == d, F.concat(w, F.lit("x"))).otherwise(w))
    return F.filter(marked, lambda _, i: i % a != b)


def pairs(spark: SparkSession, sf_dir: str, name: str = "dev") -> DataFrame:
    """(row_id, path, src, call_id, sentence, ref, a, b)."""
    d = table(spark, sf_dir, name).where("sentence is not null")
    d = d.select("row_id", "path", F.coalesce("src", F.lit("?")).alias("src"), call_id_of(F.col("path")).alias("call_id"), "sentence", words(F.col("sentence")).alias("ref"))
    return d.withColumn("a", hypothesis(F.col("ref"), "a")).withColumn("b", hypothesis(F.col("ref"), "b"))


def known_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest rows once per path, with plain split and direction, call_id from the path where null, and unknown durations null."""
    m = table(spark, sf_dir, "manifest")
    call = F.coalesce(F.col("call_id"), call_id_of(F.col("path")))
    s = F.when((F.col("duration") > 0) & ~F.isnan("duration"), F.col("duration"))
    plain = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    d = m.select("path", "sentence", s.alias("duration"), call.alias("call_id"), "part", "piece", plain("direction").alias("direction"), F.nullif("lead_id", F.lit(0)).alias("lead_id"), plain("split").alias("split"), "claude_edited")
    return d.distinct()


NORM = r"trim(regexp_replace(regexp_replace(lower(translate({0}, '‘’ʻʼ`´', '''''''''''''')), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda w: w <> '')"
CALL = "try_cast(nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^([0-9]+)', 1), '') as bigint)"


def sql_hyp(ref: str, run: str) -> str:
    a, b, c, d = RUNS[run]
    return f"list_filter(list_transform({ref}, lambda w, i: case when (i - 1) % {c} = {d} then w || 'x' else w end), lambda w, i: (i - 1) % {a} <> {b})"


PAIRS = f"""p0 as (select row_id, path, coalesce(src, '?') as src, {CALL} as call_id, sentence, {WORDS.format('sentence')} as r from dev where sentence is not null),
p as (select *, {sql_hyp('r', 'a')} as a, {sql_hyp('r', 'b')} as b from p0)"""


def sql_distance(r: str, h: str) -> str:
    """Word edit distance as a fold over rows of the table."""
    return (
        f"case when len({r}) = 0 then len({h}) else list_reduce({r}, lambda prev, x: list_reduce(range(1, len({h}) + 1), lambda cur, j: cur || [least(prev[j + 1] + 1, cur[len(cur)] + 1, "
        f"prev[j] + case when {h}[j] = x then 0 else 1 end)], [prev[1] + 1]), range(0, len({h}) + 1))[len({h}) + 1] end"
    )


KNOWN = f"""m as (select distinct path, sentence, case when duration > 0 and not isnan(duration) then duration end as duration, coalesce(call_id, {CALL}) as call_id, part, piece,
  nullif(lower(trim(direction)), '') as direction, nullif(lead_id, 0) as lead_id, nullif(lower(trim(split)), '') as split, claude_edited from manifest)"""


def md5_rank(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}::varchar), 1, 8))::bigint"


def sql_path(r: str, h: str) -> str:
    """The alignment as a string of E, S, D and I, by the same ties as the library's: each cell is six digits of cost and its path."""
    inc = "lpad((left({0}, 6)::int + 1)::varchar, 6, '0') || substr({0}, 7)"
    return (
        f"case when len({r}) = 0 then repeat('I', len({h})) else substr(list_reduce({r}, lambda prev, x: list_reduce(range(1, len({h}) + 1), lambda cur, j: cur || ["
        f"case when {h}[j] = x then prev[j] || 'E' when left(prev[j], 6) <= left(prev[j + 1], 6) and left(prev[j], 6) <= left(cur[len(cur)], 6) then {inc.format('prev[j]')} || 'S' "
        f"when left(prev[j + 1], 6) <= left(cur[len(cur)], 6) then {inc.format('prev[j + 1]')} || 'D' else {inc.format('cur[len(cur)]')} || 'I' end], [{inc.format('prev[1]')} || 'D']), "
        f"list_transform(range(0, len({h}) + 1), lambda j: lpad(j::varchar, 6, '0') || repeat('I', j::int)))[len({h}) + 1], 7) end"
    )


OPS = f"""{PAIRS}, o as (select row_id, src, r, a, {sql_path('r', 'a')} as p from p),
k as (select *, unnest(range(1, length(p) + 1)) as k from o), i as (select *, substr(p, k, 1) as c, length(replace(substr(p, 1, k - 1), 'I', '')) as ri, length(replace(substr(p, 1, k - 1), 'D', '')) as hi from k),
ops as (select row_id, src, len(r) as ref_words, case c when 'S' then 'sub' when 'D' then 'del' else 'ins' end as op, case when c <> 'I' then r[ri + 1] end as ref, case when c <> 'D' then a[hi + 1] end as hyp,
  case when c = 'I' then greatest(ri - 1, 0) else ri end as ref_idx from i where c <> 'E'),
sub0 as (select ref, hyp, count(*) as n, string_split(ref, '') as x, string_split(hyp, '') as y from ops where op = 'sub' group by 1, 2),
subs as (select ref, hyp, n, {sql_distance('x', 'y')} <= 2 as spelling from sub0)"""
