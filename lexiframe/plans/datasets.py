"""Data-set queries: gates, leaks, weights, splits, samples, mixes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cps
from ..operators import contracts, dedup, gates, mixing, scoring, splits, weighting
from .common import CALL, KNOWN, known_manifest, md5_rank, table
from .queries import query

REASON = """case when duration > 30 then 'long' when coalesce(duration < 1.2, true) then 'short' when coalesce(length(trim(sentence)) < 4, true) then 'text'
 when not (length(trim(sentence)) / duration between 6 and 26) then 'cps' end"""
EVAL = "(select distinct call_id from eval_calls_120)"


@query(f"with {KNOWN} select call_id in {EVAL} as is_eval, {REASON} as why, count(*) as n from m where call_id is not null group by 1, 2")
def gate_reasons(spark, sf_dir):
    m = known_manifest(spark, sf_dir).where("call_id is not null")
    e = table(spark, sf_dir, "eval_calls_120").select("call_id").distinct().withColumn("e", F.lit(True))
    d = m.join(e, "call_id", "left")
    why = gates.reason(gates.CALLS, F.col("duration"), F.col("sentence"))
    return d.select(F.coalesce("e", F.lit(False)).alias("is_eval"), why.alias("why")).groupBy("is_eval", "why").agg(F.count("*").alias("n"))


@query(f"with {KNOWN} select path, call_id from m where ({REASON}) is null")
def gate_kept(spark, sf_dir):
    return gates.split_by_reason(known_manifest(spark, sf_dir), gates.reason(gates.CALLS, F.col("duration"), F.col("sentence")))[0].select("path", "call_id")


@query(f"with {KNOWN} select path, case when duration = 0 then 0 else length(sentence) / duration end as cps from m where duration is not null")
def sample_cps(spark, sf_dir):
    return known_manifest(spark, sf_dir).where("duration is not null").select("path", cps(F.col("sentence"), F.col("duration")).alias("cps"))


@query(f"with {KNOWN} select path from m where call_id is not null and call_id not in {EVAL}")
def eval_exclusion(spark, sf_dir):
    m = known_manifest(spark, sf_dir).where("call_id is not null")
    return m.join(table(spark, sf_dir, "eval_calls_120").select("call_id"), "call_id", "left_anti").select("path")


@query(f"with {KNOWN} select path from m where call_id in {EVAL}")
def eval_selection(spark, sf_dir):
    m = known_manifest(spark, sf_dir)
    return m.join(table(spark, sf_dir, "eval_calls_120").select("call_id"), "call_id", "left_semi").select("path")


@query("select row_id from dev where length(sentence) > 60 and sentence in (select sentence from train where sentence is not null)")
def text_leak_rows(spark, sf_dir):
    t = table(spark, sf_dir, "train").select("sentence").where("sentence is not null").distinct()
    return table(spark, sf_dir, "dev").where(F.char_length("sentence") > 60).join(t, "sentence", "left_semi").select("row_id")


@query("select sentence, min(row_id) as row_id from train where sentence is not null group by sentence")
def first_occurrence(spark, sf_dir):
    return dedup.first_rows(table(spark, sf_dir, "train").where("sentence is not null").select("sentence", "row_id"), ["sentence"], ["row_id"])


@query(f"with {KNOWN}, h as (select call_id from m where call_id is not null group by call_id having max(part) is not null) select path from m where (call_id in (select call_id from h) and part is not null) or (call_id is not null and call_id not in (select call_id from h))")
def parts_over_wholes(spark, sf_dir):
    return dedup.prefer_parts(known_manifest(spark, sf_dir).where("call_id is not null")).select("path")


@query(f"with {KNOWN} select call_id, sum(cast(duration as decimal(18,4)))::double as seconds, count(*) as samples, sum(len(list_filter(string_split_regex(trim(sentence), '\\s+'), lambda w: w <> '')))::bigint as words, min(direction) as direction from m where call_id is not null group by call_id")
def call_rollup(spark, sf_dir):
    from ..functions.text import raw_words

    m = known_manifest(spark, sf_dir).where("call_id is not null")
    return m.groupBy("call_id").agg(F.sum(F.col("duration").cast("decimal(18,4)")).cast("double").alias("seconds"), F.count("*").alias("samples"), F.sum(F.size(raw_words(F.col("sentence")))).cast("long").alias("words"), F.min("direction").alias("direction"))


@query(f"with {KNOWN} select coalesce(split, '?') as split, count(*) as samples, count(distinct call_id) as calls, count(distinct lead_id) as leads from m group by 1")
def split_counts(spark, sf_dir):
    m = known_manifest(spark, sf_dir).withColumn("split", F.coalesce("split", F.lit("?")))
    return m.groupBy("split").agg(F.count("*").alias("samples"), F.count_distinct("call_id").alias("calls"), F.count_distinct("lead_id").alias("leads"))


@query(f"with {KNOWN} select max(n) as largest from (select count(*) as n from m where lead_id is not null group by lead_id)")
def largest_lead(spark, sf_dir):
    return known_manifest(spark, sf_dir).where("lead_id is not null").groupBy("lead_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))


SCORES = f"""{KNOWN}, s as (select path, case when length(sentence) % 3 = 0 then null else round((length(sentence) * 13 % 100) / 100.0, 2) end as wer from m)"""


def _scored(spark, sf_dir):
    """manifest rows with a stand-in score: none for every third length, else 13 * length modulo 100 in percent."""
    m = known_manifest(spark, sf_dir)
    n = F.char_length("sentence")
    by_path = m.select("path", F.when(n % 3 != 0, F.round((n * 13 % 100) / F.lit(100.0), 2)).alias("wer"))
    return weighting.with_scores(m, by_path)


@query(f"""with {SCORES}, c as (select list_sort(list(wer)) as w from s where wer is not null), t as (select w[least((len(w) * 0.95)::decimal(18,2)::double, len(w) - 1)::bigint + 1] as cut from c),
k as (select m.path, s.wer from m join s using (path) where ({REASON}) is null and not coalesce(s.wer >= (select w[floor(len(w) * 0.95)::bigint + 1] from c), false))
select path, x.copy::bigint as copy from k, (select unnest(range(1, 4)) as copy) x where x.copy <= case when wer is null or wer < 0.3 then 1 when wer >= 0.6 then 3 else 2 end""")
def weighted_rows(spark, sf_dir):
    d = _scored(spark, sf_dir)
    cut = weighting.cutoff(d)
    why = gates.reason(gates.CALLS, F.col("duration"), F.col("sentence"), last=[(F.col("wer") >= F.lit(cut), "worst")] if cut is not None else None)
    kept, _ = gates.split_by_reason(d, why)
    return weighting.replicate(kept, weighting.repeat_factor(F.col("wer"))).select("path", F.col("copy").cast("long").alias("copy"))


@query(f"with {SCORES} select count(*) as rows, count(wer) as scored, count(wer)::double / count(*) as share from m join s using (path)")
def score_coverage(spark, sf_dir):
    d = _scored(spark, sf_dir).agg(F.count("*").alias("rows"), F.count("wer").alias("scored"))
    r = d.first()
    contracts.scored_enough(r["rows"], r["scored"])
    return d.withColumn("share", F.col("scored").cast("double") / F.col("rows"))


@query(f"""with {KNOWN}, g as (select distinct call_id from m where call_id is not null), r as (select call_id, row_number() over (order by {md5_rank('call_id', 42)}, call_id) as k, count(*) over () as n from g)
select call_id, case when k <= greatest(12, floor(n * 0.08 + 0.5)) then 'dev' else 'train' end as split from r""")
def hash_group_split(spark, sf_dir):
    g = known_manifest(spark, sf_dir).where("call_id is not null").select("call_id").distinct()
    return splits.split_by_group(g, "call_id", 0.08, 42, least=12)


@query(f"""with recursive {KNOWN}, s as (select coalesce('L' || lead_id, 'C' || call_id) as grp, duration from m where coalesce(lead_id, call_id) is not null),
g as (select grp, count(*) as samples, coalesce(sum(coalesce(duration, 0)::decimal(20, 6)), 0)::double as d from s group by 1), t as (select sum(d) as total from g),
o as (select *, row_number() over (order by {md5_rank('grp', 7)}, grp) as k from g, t where d <= 0.03 * total),
f as (select 0::bigint as k, 0::double as have, ''::varchar as pick union all select o.k, case when f.have < 0.1 * total and f.have + d <= 0.1 * total * 1.08 then f.have + d else f.have end, case when f.have < 0.1 * total and f.have + d <= 0.1 * total * 1.08 then grp else '' end from f join o on o.k = f.k + 1)
select grp as "group", case when grp in (select pick from f) then 'dev' else 'train' end as split, samples from g""")
def lead_disjoint_split(spark, sf_dir):
    m = known_manifest(spark, sf_dir).withColumn("group", F.coalesce(F.concat(F.lit("L"), F.col("lead_id").cast("string")), F.concat(F.lit("C"), F.col("call_id").cast("string"))))
    d = splits.capped_fill(m.where("group is not null"), "group", F.col("duration"), 0.1, 7)
    return d.groupBy("group", "split").agg(F.count("*").alias("samples"))


@query(f"select row_id, case when {md5_rank('row_id', 5)} < {int(0.02 * (1 << 32))} then 'dev' else 'train' end as split from train")
def row_split(spark, sf_dir):
    return splits.random_rows(table(spark, sf_dir, "train").select("row_id"), "row_id", 0.02, 5)


@query("""with s as (select batch, coalesce(direction, '?') as direction, count(*) as n from eval_calls_120 where not locked group by 1, 2), e as (select *, 50 * n / sum(n) over () as x from s),
q as (select *, floor(x) as f, x - floor(x) as r from e) select batch, direction, n, (f + case when row_number() over (order by r desc, batch desc, direction desc) <= 50 - sum(f) over () then 1 else 0 end)::bigint as quota from q""")
def remainder_quota(spark, sf_dir):
    s = table(spark, sf_dir, "eval_calls_120").where("not locked").groupBy("batch", F.coalesce("direction", F.lit("?")).alias("direction")).agg(F.count("*").alias("n"))
    return splits.largest_remainder(s, "n", 50, ["batch", "direction"])


@query("""with s as (select call_id, coalesce(direction, '?') as direction, row_number() over (partition by coalesce(direction, '?') order by duration, call_id) - 1 as k, count(*) over (partition by coalesce(direction, '?')) as n from eval_calls_120),
t as (select *, least(5, n) as t from s), i as (select *, unnest(range(0, t)) as i from t) select call_id, direction from i where floor(i * (n / t) + n / t / 2) = k""")
def systematic_pick(spark, sf_dir):
    e = table(spark, sf_dir, "eval_calls_120").withColumn("direction", F.coalesce("direction", F.lit("?")))
    return splits.systematic(e, ["direction"], ["duration", "call_id"], F.lit(5)).select("call_id", "direction")


@query("""with s as (select call_id, batch, row_number() over (partition by batch order by duration, call_id) - 1 as k, greatest(1, count(*) over (partition by batch) // 4) as q from eval_calls_120)
select call_id, batch, case when k // q < 4 then (k // q)::int end as quartile from s""")
def duration_quartiles(spark, sf_dir):
    return splits.quartile(table(spark, sf_dir, "eval_calls_120").select("call_id", "batch", "duration"), ["batch"], ["duration", "call_id"]).select("call_id", "batch", "quartile")


@query(f"""with {KNOWN}, l as (select call_id, min(lead_id) as lead_id from m group by 1),
c as (select e.call_id, batch, coalesce(direction, '?') as direction, duration, locked, lead_id from eval_calls_120 e left join l using (call_id)),
s as (select batch, direction, count(*) as n, count(*) filter (locked) as have from c group by 1, 2), g0 as (select *, round_even(50 * n / sum(n) over (), 0)::bigint as g from s),
g as (select *, g + case when row_number() over (order by n desc, batch, direction) = 1 then 50 - sum(g) over () else 0 end as goal from g0),
q0 as (select *, row_number() over (partition by batch, direction order by duration nulls first, call_id) - 1 as k, greatest(1, count(*) over (partition by batch, direction) // 4) as q from c where not locked),
q as (select *, least(k // q, 4) as quartile, {md5_rank('call_id', 11)} as h from q0),
a as (select *, lead_id is not null and row_number() over (partition by batch, direction, quartile, lead_id order by h, call_id) > 1 as again from q),
p as (select *, row_number() over (partition by batch, direction, quartile order by again, h, call_id) as pick from a),
o as (select *, row_number() over (partition by batch, direction order by quartile = 4, pick, quartile, call_id) as o from p)
select call_id, batch, direction, locked from o join g using (batch, direction) where o <= goal - have union all select call_id, batch, direction, locked from c where locked""")
def stratified_eval_sample(spark, sf_dir):
    c = table(spark, sf_dir, "eval_calls_120").select("call_id", "batch", F.coalesce("direction", F.lit("?")).alias("direction"), "duration", "locked")
    leads = known_manifest(spark, sf_dir).groupBy("call_id").agg(F.min("lead_id").alias("lead_id"))
    d = c.join(leads, "call_id", "left")
    return splits.stratified_with_locked(d, ["batch", "direction"], 50, 11).select("call_id", "batch", "direction", "locked")


@query(f"""with {KNOWN}, d as (select * from m where split = 'dev'), t as (select * from m where split = 'train')
select (select count(*) from (select distinct call_id from d where call_id is not null intersect select distinct call_id from t)) as shared_calls,
 (select count(*) from (select distinct lead_id from d where lead_id is not null intersect select distinct lead_id from t)) as shared_leads,
 (select count(*) from (select distinct path from d intersect select distinct path from t)) as shared_paths,
 (select count(*) - count(distinct path) from manifest where path is not null) as repeated_paths,
 (select count(*) from (select call_id from eval_calls_120 except select call_id from m)) as missing_eval""")
def split_contract_counts(spark, sf_dir):
    m = known_manifest(spark, sf_dir)
    d, t = m.where("split = 'dev'"), m.where("split = 'train'")

    def shared(c: str):
        return d.where(F.col(c).isNotNull()).select(c).intersect(t.select(c)).agg(F.count("*").alias(f"shared_{c.split('_')[0]}s"))

    raw = table(spark, sf_dir, "manifest").where("path is not null").agg((F.count("*") - F.count_distinct("path")).alias("repeated_paths"))
    gone = table(spark, sf_dir, "eval_calls_120").select("call_id").exceptAll(m.select("call_id").distinct()).agg(F.count("*").alias("missing_eval"))
    out = shared("call_id")
    for x in (shared("lead_id"), shared("path"), raw, gone):
        out = out.crossJoin(x)  # one row each
    return out


@query("select distinct call_id from (select call_id from eval_calls_120 union all select db_call_id from calls where answered = 1)")
def union_of_ids(spark, sf_dir):
    a = table(spark, sf_dir, "eval_calls_120").select("call_id")
    return a.union(table(spark, sf_dir, "calls").where("answered = 1").select("db_call_id")).distinct()


@query("select doc_id from documents where n_files >= 1 and n_chars % 3 = 0")
def votes_first_rule(spark, sf_dir):
    """Files stand in for up votes, the remainder of the length for down votes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_files").alias("up_votes"), (F.col("n_chars") % 3).alias("down_votes"))
    return gates.votes_v1(d).select("doc_id")


@query("select doc_id from documents where coalesce(n_files, 0) - coalesce(n_chars % 3, 0) >= 1")
def votes_second_rule(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_files").alias("up_vote"), (F.col("n_chars") % 3).alias("downvotes"))
    up, down = mixing.vote_columns(d)
    return gates.votes_v2(d, up, down, 1).select("doc_id")


@query("""with u as (select 'train' as source, row_id as id, trim(sentence) as sentence from train union all select 'dev', row_id, trim(sentence) from dev union all select 'documents', doc_id, trim(text) from documents)
select source, count(*) as rows, sum(length(sentence))::bigint as chars from u where sentence <> '' group by source""")
def source_union(spark, sf_dir):
    parts = [mixing.resolved(table(spark, sf_dir, "train").select(F.col("row_id").alias("id"), "sentence", "src"), "train"), mixing.resolved(table(spark, sf_dir, "dev").select(F.col("row_id").alias("id"), "sentence", "lang"), "dev"), mixing.resolved(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "documents")]
    u = mixing.union_sources(parts)
    return u.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.char_length("sentence")).alias("chars"))


@query(f"select row_id from train where trim(sentence) <> '' order by {md5_rank('row_id', 42)}, row_id limit 200")
def capped_source(spark, sf_dir):
    t = table(spark, sf_dir, "train").where("trim(sentence) <> ''").select("row_id")
    return mixing.capped(t, "row_id", 200, 42)


MIX = "(select greatest(1, round(0.5 * (select count(*) from train where path not like 'audio/%') / (0.5 * greatest(1, (select count(*) from dev where path like 'audio/%'))))::bigint) as r)"


@query(f"""select 0 as kind, row_id, 1::bigint as copy from train where path not like 'audio/%'
union all select 1, row_id, x.copy from dev, {MIX} m, (select unnest(range(1, 1000)) as copy) x where path like 'audio/%' and x.copy <= m.r""")
def oversampled_mix(spark, sf_dir):
    """Call rows of dev repeated to half of a mix with the external rows of train; kind 0 external, 1 call."""
    ext = table(spark, sf_dir, "train").where("path not like 'audio/%'").select(F.lit(0).alias("kind"), "row_id", F.lit(1).cast("long").alias("copy"))
    calls = table(spark, sf_dir, "dev").where("path like 'audio/%'").select(F.lit(1).alias("kind"), "row_id")
    r = mixing.oversample_ratio(calls.count(), ext.count(), 0.5)
    return ext.union(weighting.replicate(calls, F.lit(r)).select("kind", "row_id", F.col("copy").cast(T.LongType())))


@query(f"with {KNOWN} select path, coalesce(split, 'unset') as split_v1 from m")
def default_split(spark, sf_dir):
    return known_manifest(spark, sf_dir).select("path", F.coalesce("split", F.lit("unset")).alias("split_v1"))


@query(f"""select path from (select path, {CALL} as c from train) t where c in (select call_id from eval_calls_120)""")
def train_rows_of_eval_calls(spark, sf_dir):
    from ..functions.text import call_id_of

    e = table(spark, sf_dir, "eval_calls_120").select("call_id")
    return table(spark, sf_dir, "train").select("path", call_id_of(F.col("path")).alias("call_id")).join(e, "call_id", "left_semi").select("path")


@query(f"""with {SCORES}, k as (select m.duration, case when wer is null or wer < 0.3 then 1 when wer >= 0.6 then 3 else 2 end as c from m join s using (path))
select count(*) as rows, sum(c)::bigint as repeated_rows, sum(coalesce(duration, 0)::decimal(18, 4))::double / 3600 as hours, sum(coalesce(duration, 0)::decimal(18, 4) * c)::double / 3600 as weighted_hours from k""")
def weighted_hours(spark, sf_dir):
    return weighting.hours(_scored(spark, sf_dir), "duration", weighting.repeat_factor(F.col("wer")))


@query("select doc_id, lang from documents where lang is not null")
def without_errors(spark, sf_dir):
    """Documents as results of a run; one without a language stands for a failed one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("lang").isNull(), "failed").alias("error"))
    return scoring.without_errors(d).select("doc_id", "lang")


@query("select call_id, batch from eval_calls_120")
def published_calls(spark, sf_dir):
    return mixing.published(table(spark, sf_dir, "eval_calls_120").select("call_id", "batch", F.col("locked").alias("_locked")))


@query("select path, row_id from dev where path is not null order by path, row_id limit 100")
def first_by_path(spark, sf_dir):
    return mixing.in_order(table(spark, sf_dir, "dev").where("path is not null").select("path", "row_id"), ["path", "row_id"], 100)


@query("select call_id, samples from (select call_id, samples from eval_calls_120 order by call_id)")
def sorted_by_call(spark, sf_dir):
    return mixing.in_order(table(spark, sf_dir, "eval_calls_120").select("call_id", "samples"), ["call_id"])


@query("select row_id, src from (select * from (select * from train order by row_id limit 5000) where length(trim(sentence)) >= 40 order by row_id limit 300)")
def pulled_until(spark, sf_dir):
    """The first 300 long enough rows among the first 5000."""
    t = table(spark, sf_dir, "train").select("row_id", "src", "sentence")
    return mixing.until_kept(t, ["row_id"], F.char_length(F.trim("sentence")) >= 40, 300, 5000).select("row_id", "src")


@query(f"""with {KNOWN}, l as (select path, coalesce('L' || min(lead_id), 'C' || min(call_id)) as lead, max(coalesce(claude_edited, false)) as edited from m group by path) select row_id, lead, edited from dev left join l using (path)""")
def rows_with_lead(spark, sf_dir):
    return mixing.with_lead(table(spark, sf_dir, "dev").select("row_id", "path"), known_manifest(spark, sf_dir)).select("row_id", "lead", "edited")


@query("select count(*) as rows, min(doc_id) as first from documents")
def resolved_sources(spark, sf_dir):
    """A source that can't be opened is skipped; the other one's rows stay."""
    docs = lambda: table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x"), F.col("text")).alias("text"))
    u, failed = mixing.union_of({"documents": docs, "absent": lambda: table(spark, sf_dir, "absent")})
    assert failed.keys() == {"absent"}
    return u.agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"))


@query(f"""with s as (select sentence, length(trim(sentence)) as n from train where sentence is not null) select case when n >= 5 then 'kept' else 'text' end as why, count(*) as n from s group by 1""")
def corpus_gate(spark, sf_dir):
    """The gate of external corpora over train; ten characters a second stand in for the unknown durations, bounded to the gate's."""
    t = table(spark, sf_dir, "train").where("sentence is not null").select("sentence")
    n = F.char_length(F.trim("sentence"))
    why = gates.reason(gates.CORPUS, F.when(n >= 5, F.lit(2.0)).otherwise(F.lit(2.0)), F.col("sentence"))
    d = t.select(F.when((why == "text"), "text").otherwise("kept").alias("why"))
    return d.groupBy("why").agg(F.count("*").alias("n"))
