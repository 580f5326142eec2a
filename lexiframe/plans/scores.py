"""Scoring and error mining queries over dev with the synthetic runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import DOMAIN_TERMS, longest_repeat, norm, order_key, raw_words, repeated_trigrams, spell, words
from ..operators import compare, mining, scoring
from .common import KNOWN, NORM, OPS, PAIRS, WORDS, known_manifest, md5_rank, pairs, sql_distance, table
from .queries import query

DIST_A, DIST_B = sql_distance("r", "a"), sql_distance("r", "b")


def _scored(spark: SparkSession, sf_dir: str, run: str = "a") -> DataFrame:
    return scoring.scores(pairs(spark, sf_dir), F.col("ref"), F.col(run)).where("ref_words > 0")


@query(f"select row_id, {NORM.format('sentence')} as norm from train where sentence is not null")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "train").where("sentence is not null").select("row_id", norm(F.col("sentence")).alias("norm"))


@query(f"""select row_id, len(list_filter(string_split_regex(trim(sentence), '\\s+'), lambda w: w <> ''))::bigint as raw_words, len({WORDS.format('sentence')})::bigint as norm_words
from train where sentence is not null""")
def word_counts(spark, sf_dir):
    s = F.col("sentence")
    return table(spark, sf_dir, "train").where(s.isNotNull()).select("row_id", F.size(raw_words(s)).cast("long").alias("raw_words"), F.size(words(s)).cast("long").alias("norm_words"))


@query(f"""with {PAIRS}, s as (select src, len(r) as n, {DIST_A} as d from p where len(r) > 0)
select src, sum(n)::bigint as ref_words, sum(d)::bigint as errors, sum(d)::double / sum(n) as wer from s group by src""")
def corpus_wer_by_src(spark, sf_dir):
    return scoring.corpus_wer(_scored(spark, sf_dir), ["src"])


@query(f"""with {PAIRS}, s as (select row_id, len(r) as n, len(a) as h, {DIST_A} as d from p where len(r) > 0)
select row_id, n::bigint as ref_words, h::bigint as hyp_words, d::bigint as errors, d::double / n as wer, h::double / n as coverage from s""")
def sample_wer(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("row_id", "ref_words", "hyp_words", "errors", (F.col("errors").cast("double") / F.col("ref_words")).alias("wer"), (F.col("hyp_words").cast("double") / F.col("ref_words")).alias("coverage"))


@query(f"""with {PAIRS}, s as (select 'a' as run_id, len(r) as n, {DIST_A} as d from p union all select 'b', len(r), {DIST_B} from p)
select run_id, sum(n)::bigint as ref_words, sum(d)::bigint as errors, sum(d)::double / sum(n) as wer from s group by run_id""")
def run_wer(spark, sf_dir):
    p = pairs(spark, sf_dir)
    runs = p.select("ref", F.explode(F.array(*[F.struct(F.lit(r).alias("run_id"), F.col(r).alias("hyp")) for r in ("a", "b")])).alias("x")).select("ref", "x.run_id", "x.hyp")
    return scoring.corpus_wer(scoring.scores(runs, F.col("ref"), F.col("hyp")), ["run_id"])


RAW = "list_filter(string_split_regex(trim(sentence), '\\s+'), lambda w: w <> '')"


@query(f"""with p as (select coalesce(src, '?') as src, {RAW} as r, list_transform({RAW}, lambda w, i: case when (i - 1) % 3 = 1 then lower(w) || '.' else w end) as h from dev where sentence is not null)
select src, sum(len(r))::bigint as ref_words, sum({sql_distance('r', 'h')})::bigint as errors, sum({sql_distance('r', 'h')})::double / sum(len(r)) as wer from p group by src""")
def raw_wer_by_src(spark, sf_dir):
    r = raw_words(F.col("sentence"))
    d = table(spark, sf_dir, "dev").where("sentence is not null").select(F.coalesce("src", F.lit("?")).alias("src"), r.alias("r"))
    d = d.withColumn("h", F.transform("r", lambda w, i: F.when(i % 3 == 1, F.concat(F.lower(w), F.lit("."))).otherwise(w)))
    return scoring.corpus_wer(scoring.scores(d, F.col("r"), F.col("h")), ["src"])


PACKED = """case when len(r) = 0 then len(a) else list_reduce(r, lambda prev, x: list_reduce(range(1, len(a) + 1), lambda cur, j: cur || [
  case when a[j] = x then prev[j]
    when prev[j] // 1000000000 <= prev[j + 1] // 1000000000 and prev[j] // 1000000000 <= cur[len(cur)] // 1000000000 then prev[j] + 1001000000
    when prev[j + 1] // 1000000000 <= cur[len(cur)] // 1000000000 then prev[j + 1] + 1000001000
    else cur[len(cur)] + 1000000001 end], [prev[1] + 1000001000]), list_transform(range(0, len(a) + 1), lambda j: j * 1000000001))[len(a) + 1] end"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_counts(pairs(spark, sf_dir), F.col("ref"), F.col("a")).withColumn("ref_words", F.size("ref"))


@query(f"""with {PAIRS}, s as (select src, {PACKED} as x from p where len(r) > 0),
t as (select src, sum(x // 1000000 % 1000)::bigint as subs, sum(x // 1000 % 1000)::bigint as dels, sum(x % 1000)::bigint as ins from s group by src)
select *, subs::double / greatest(subs + dels + ins, 1) as subs_share, dels::double / greatest(subs + dels + ins, 1) as dels_share, ins::double / greatest(subs + dels + ins, 1) as ins_share from t""")
def error_kinds_by_src(spark, sf_dir):
    return scoring.shares(_counted(spark, sf_dir).where("ref_words > 0"), ["src"])


@query(f"""with {OPS}, c as (select op, ref, hyp, count(*) as n from ops group by 1, 2, 3), x as (select *, row_number() over (partition by op order by n desc, ref collate "C" nulls first, hyp collate "C" nulls first)::int as rank from c)
select * from x where rank <= 40""")
def confusion_top(spark, sf_dir):
    return mining.most_common(mining.confusions(mining.exploded_ops(_counted(spark, sf_dir), ["row_id"])), 40)


@query(f"""with {OPS}, d as (select least(floor(ref_idx / ref_words * 10), 9)::int as decile, count(*) as n from ops where ref_words > 0 group by 1) select decile, n, 100.0 * n / sum(n) over () as percent from d""")
def error_position_deciles(spark, sf_dir):
    return mining.position_deciles(mining.exploded_ops(_counted(spark, sf_dir), ["row_id"]))


@query(f"with {OPS} select spelling, sum(n)::bigint as n from subs group by 1")
def spelling_vs_acoustic(spark, sf_dir):
    s = scoring.spelling_split(mining.exploded_ops(_counted(spark, sf_dir), ["row_id"]))
    return s.groupBy("spelling").agg(F.sum("n").alias("n"))


@query(f"with {OPS} select ref, sum(n)::bigint as n from subs where " + " or ".join(f"contains(ref, '{t}')" for t in DOMAIN_TERMS) + " group by 1")
def domain_term_hits(spark, sf_dir):
    s = scoring.spelling_split(mining.exploded_ops(_counted(spark, sf_dir), ["row_id"]))
    return mining.domain_hits(s)


SPELL = """case when w in ('hm','hmm','ha','aha','ahaa','aa','ah','xa','he','ehe','mhm','uhu') then 'ha'
 when w in ('vaalaykum','valaykum','vaalayqum','alaykum','aleykum','alaykm') then 'alaykum' when w in ('assalomu','assalom','salom','assalamu') then 'assalom'
 when w in ('allo','alo','alyo','allyo') then 'alo' when w in ('xo''p','xop','hop','ho''p') then 'xo''p' when w in ('yo''q','yoq','yo') then 'yo''q'
 when w = '0' then 'nol' when w = '1' then 'bir' when w = '2' then 'ikki' when w = '3' then 'uch' when w = '4' then 'to''rt' when w = '5' then 'besh' when w = '6' then 'olti'
 when w = '7' then 'yetti' when w = '8' then 'sakkiz' when w = '9' then 'to''qqiz' when w = '10' then 'o''n' when w = '100' then 'yuz' when w = '1000' then 'ming'
 else array_to_string(list_reduce(string_split(w, ''), lambda acc, c: case when acc[len(acc)] = c then acc else acc || [c] end, ['']), '') end"""


@query(f"""with x as (select unnest({WORDS.format('sentence')}) as w from dev where sentence is not null) select w as word, {SPELL} as spelled, count(*) as n from x group by w""")
def rule_spelled_words(spark, sf_dir):
    w = table(spark, sf_dir, "dev").where("sentence is not null").select(F.explode(words(F.col("sentence"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", spell(F.col("word")).alias("spelled"), "n")


@query(f"""with {PAIRS}, q as (select src, list_transform(r, lambda w: {SPELL}) as r, list_transform(a, lambda w: {SPELL}) as a from p where len(r) > 0), s as (select src, len(r) as n, {DIST_A} as d from q)
select src, sum(n)::bigint as ref_words, sum(d)::bigint as errors, sum(d)::double / sum(n) as wer from s group by src""")
def rule_normalised_wer(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return scoring.corpus_wer(scoring.scores(p, scoring.spelled(F.col("ref")), scoring.spelled(F.col("a"))).where("ref_words > 0"), ["src"])


@query("""select *, words / greatest(sentences, 1) as sentence_words, 100.0 * capitals / greatest(words, 1) as capital_percent from (select coalesce(src, '?') as src, sum(len(list_filter(string_split_regex(trim(sentence), '\\s+'), lambda w: w <> '')))::bigint as words,
 sum(len(list_filter(string_split_regex(sentence, '[.!?]+'), lambda x: trim(x) <> '')))::bigint as sentences, sum(len(list_filter(string_split_regex(trim(sentence), '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}'))))::bigint as capitals,
 sum(len(sentence) - len(replace(sentence, '.', '')))::bigint as dots, sum(len(sentence) - len(replace(sentence, ',', '')))::bigint as commas,
 sum(len(sentence) - len(replace(sentence, '?', '')))::bigint as questions, sum(len(sentence) - len(replace(sentence, '!', '')))::bigint as bangs
from train where sentence is not null group by 1)""".replace("select *,", "select * exclude (capitals),", 1))
def punctuation_by_src(spark, sf_dir):
    d = table(spark, sf_dir, "train").where("sentence is not null").withColumn("src", F.coalesce("src", F.lit("?")))
    return scoring.punctuation(d, "sentence", ["src"]).select("src", "words", "dots", "commas", "questions", "bangs", "sentences", "sentence_words", "capital_percent")


@query(f"""with {KNOWN}, k as (select call_id, path, sentence, coalesce(try_cast(nullif(regexp_extract(path, '_p([0-9]+)', 1), '') as int), 1) * 100 + coalesce(try_cast(nullif(regexp_extract(path, '_s([0-9]+)', 1), '') as int), 0) as o from m where call_id is not null and sentence is not null)
select call_id, md5(string_agg(sentence, ' ' order by o, path collate "C")) as text_md5, count(*) as samples from k group by call_id""")
def call_texts(spark, sf_dir):
    m = known_manifest(spark, sf_dir).where("call_id is not null and sentence is not null")
    t = scoring.ordered_text(m, "call_id", order_key(F.col("path")), "path", "sentence")
    return t.select("call_id", F.md5("text").alias("text_md5"), "samples")


@query()
def call_wer(spark, sf_dir):
    """Error rate of whole calls: texts of a call's samples in order against the first synthetic run."""
    from .common import hypothesis

    m = known_manifest(spark, sf_dir).where("call_id is not null and sentence is not null")
    t = scoring.ordered_text(m, "call_id", order_key(F.col("path")), "path", "sentence").select("call_id", words(F.col("text")).alias("ref"))
    return scoring.scores(t.withColumn("hyp", hypothesis(F.col("ref"), "a")), F.col("ref"), F.col("hyp")).where("ref_words > 0").select("call_id", "ref_words", "errors")


@query(f"""with {PAIRS}, s as (select row_id, len(r) as n, {DIST_A} as d from p where len(r) > 0), w as (select *, d::double / n as wer, row_number() over (order by d::double / n desc, row_id) as k, count(*) over () as c from s)
select row_id, n::bigint as ref_words, d::bigint as errors from w where k > greatest(1, floor(0.05 * c)) and k <= greatest(1, floor(0.05 * c)) + 60""")
def hard_examples(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return mining.hard_examples(s, F.col("errors").cast("double") / F.col("ref_words"), "row_id").select("row_id", "ref_words", "errors")


@query(f"""with {KNOWN}, x as (select direction, list_sort(list(duration)) as d, median(duration) as med, quantile_cont(duration, 0.9) as p90 from m where duration is not null and direction is not null group by direction)
select direction, med, d[len(d) // 2 + 1] as upper_median, d[least(floor(len(d) * 0.9), len(d) - 1)::bigint + 1] as share90, d[len(d) * 9 // 10 + 1] as decile9, p90 from x""")
def quantile_zoo(spark, sf_dir):
    m = known_manifest(spark, sf_dir).where("duration is not null and direction is not null")
    n = F.col("n")
    at = (n - 1) * 0.9
    ranks = {"low": F.floor((n - 1) / 2), "upper_median": F.floor(n / 2), "share90": F.least(F.floor(n * 0.9), n - 1), "decile9": F.floor(n * 9 / 10), "p_low": F.floor(at), "p_high": F.ceil(at)}
    d = stats.at_ranks(m, ["direction"], "duration", ranks)
    p90 = F.col("p_low") + (at - F.floor(at)) * (F.col("p_high") - F.col("p_low"))
    return d.select("direction", ((F.col("low") + F.col("upper_median")) / 2).alias("med"), "upper_median", "share90", "decile9", p90.alias("p90"))


@query(f"""with {PAIRS}, s as (select call_id, len(r) as n, {DIST_A} as d, {DIST_B} as e, m.duration from p join (select path, max(case when duration > 0 and not isnan(duration) then duration end) as duration from manifest group by path) m using (path) where len(r) > 0)
select case when duration < 8 then '<8' when duration < 15 then '8-15' when duration < 22 then '15-22' when duration <= 31 then '22-31' else '>31' end as bucket, sum(n)::bigint as ref_words, sum(d)::bigint as errors from s where duration is not null group by 1""")
def duration_bucket_errors(spark, sf_dir):
    s = _scored(spark, sf_dir)
    d = table(spark, sf_dir, "manifest").groupBy("path").agg(F.max(F.when((F.col("duration") > 0) & ~F.isnan("duration"), F.col("duration"))).alias("duration"))
    j = s.join(d, "path").where("duration is not null").withColumn("bucket", mining.duration_buckets(F.col("duration")))
    return j.groupBy("bucket").agg(F.sum("ref_words").alias("ref_words"), F.sum("errors").alias("errors"))


@query(f"""with w as (select row_id, {WORDS.format('sentence')} as w from train where sentence is not null), u as (select row_id, w, unnest(range(1, len(w) + 1)) as i from w),
n as (select row_id, i, w[i] as x, case when i > 1 and w[i] = w[i - 1] then 0 else 1 end as new, case when i + 2 <= len(w) then w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as g from u),
l as (select *, sum(new) over (partition by row_id order by i) as island from n), r as (select row_id, max(c)::int as run from (select row_id, island, count(*) as c from l group by 1, 2) group by 1),
t as (select row_id, (count(g) - count(distinct g))::int as trigrams from n group by 1) select row_id, run, trigrams from r join t using (row_id) where run >= 4 or trigrams > 0""")
def repetition_check(spark, sf_dir):
    w = words(F.col("sentence"))
    d = table(spark, sf_dir, "train").where("sentence is not null").select("row_id", w.alias("w")).select("row_id", longest_repeat(F.col("w")).alias("run"), repeated_trigrams(F.col("w")).alias("trigrams"))
    return d.where("run >= 4 or trigrams > 0")


def units_sql(unit: str, rounds: int) -> str:
    return f"""{PAIRS}, u as (select {unit} as unit, sum(len(r)) as w, sum({DIST_A}) as x, sum({DIST_B}) as y from p where len(r) > 0 and {unit} is not null group by 1),
i as (select *, row_number() over (order by {md5_rank('unit', 0)}, unit) - 1 as i, count(*) over () as c from u),
rounds as (select unnest(range(0, {rounds})) as round), n as (select count(*) as n from u),
k as (select unnest(range(0, (select n from n))) as k),
draws as (select round, ('0x' || substr(md5('0|' || round || '|' || k), 1, 8))::bigint % (select n from n) as i from rounds, k)"""


def summary_sql(unit: str) -> str:
    return f"""with {units_sql(unit, 1000)}, r as (select round, (sum(y) - sum(x))::double / sum(w) as diff from draws join i using (i) group by round), d as (select list_sort(list(diff)) as d from r),
s as (select d[floor(len(d) * 0.025)::int + 1] as lo, d[floor(len(d) * 0.975)::int + 1] as hi, least(1.0, 2 * least(len(list_filter(d, lambda x: x <= 0)) / len(d), len(list_filter(d, lambda x: x >= 0)) / len(d))) as p from d)
select *, case when hi < 0 then 'better' when lo > 0 then 'worse' else 'not reliable' end as verdict from s"""


@query(f"with {units_sql('row_id', 500)} select round::bigint as round, (sum(y) - sum(x))::double / sum(w) as diff from draws join i using (i) group by round")
def paired_bootstrap_draws(spark, sf_dir):
    return compare.bootstrap_draws(_units(spark, sf_dir, "row_id"), 500, 0)


def _units(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    p = pairs(spark, sf_dir).where(F.size("ref") > 0)
    s = scoring.scores(p, F.col("ref"), F.col("a")).withColumnRenamed("errors", "a_errors").withColumnRenamed("ref_words", "words").drop("hyp_words")
    s = s.withColumn("b_errors", scoring.word_distance(F.col("ref"), F.col("b")).cast("long"))
    return s.groupBy(F.col(unit).alias("unit")).agg(F.sum("words").alias("words"), F.sum("a_errors").alias("a_errors"), F.sum("b_errors").alias("b_errors"))


@query(summary_sql("row_id"))
def paired_bootstrap(spark, sf_dir):
    return compare.bootstrap_summary(compare.bootstrap_draws(_units(spark, sf_dir, "row_id"), 1000, 0))


@query(summary_sql("call_id"))
def cluster_bootstrap(spark, sf_dir):
    return compare.bootstrap_summary(compare.bootstrap_draws(_units(spark, sf_dir, "call_id").where("unit is not null"), 1000, 0))


@query(f"""with {PAIRS}, s as (select row_id, {DIST_A} as x, {DIST_B} as y from p where len(r) > 0)
select count(*) filter (y < x and row_id % 10 <> 1 and row_id % 10 <> 2) as better, count(*) filter (y > x and row_id % 10 <> 1 and row_id % 10 <> 2) as worse, count(*) filter (y = x and row_id % 10 <> 1 and row_id % 10 <> 2) as equal,
 count(*) filter (row_id % 10 = 2) as only_a, count(*) filter (row_id % 10 = 1) as only_b from s""")
def run_outcomes(spark, sf_dir):
    """Run a failed on rows ending in 1, run b on rows ending in 2."""
    a = _scored(spark, sf_dir, "a").where("row_id % 10 <> 1").select("row_id", "errors", "ref_words")
    b = _scored(spark, sf_dir, "b").where("row_id % 10 <> 2").select("row_id", "errors", "ref_words")
    m = compare.matched(a, b, "row_id")
    return m.agg(*[F.count_if((F.col("side") == "both") & c).alias(n) for n, c in (("better", F.col("b_errors") < F.col("a_errors")), ("worse", F.col("b_errors") > F.col("a_errors")), ("equal", F.col("b_errors") == F.col("a_errors")))], *[F.count_if(F.col("side") == s).alias(s) for s in ("only_a", "only_b")])


@query(f"""with {PAIRS}, s as (select p.sentence in (select sentence from train where sentence is not null) as seen, len(r) as n, {DIST_A} as d from p where len(r) > 0)
select seen, sum(n)::bigint as ref_words, sum(d)::bigint as errors, sum(d)::double / sum(n) as wer from s group by seen""")
def seen_unseen_wer(spark, sf_dir):
    s = compare.seen_flag(_scored(spark, sf_dir), [table(spark, sf_dir, "train")])
    return scoring.corpus_wer(s, ["seen"])


@query(f"""with {OPS}, e as (select row_id, count(*) as e, count(*) filter (op = 'sub' and spelling) as s from ops left join (select ref, hyp, spelling from subs) using (ref, hyp) group by 1)
select p.src, sum(len(r))::bigint as ref_words, sum(coalesce(e, 0))::bigint as errors, sum(coalesce(s, 0))::bigint as spelling, (sum(coalesce(e, 0)) - sum(coalesce(s, 0)))::double / sum(len(r)) as wer from p left join e using (row_id) where len(r) > 0 group by 1""")
def spelling_normalised_wer(spark, sf_dir):
    return scoring.spelling_forgiven(_counted(spark, sf_dir).where("ref_words > 0"), ["src"])


@query(f"""with {PAIRS}, s as (select src, len(r) as n, len(a) as h, {DIST_A} as d from p where len(r) > 0)
select src, count(*) as samples, sum(d)::double / sum(n) as wer, sum(h)::double / sum(n) as coverage, median(d::double / n) as median from s group by 1""")
def source_summary(spark, sf_dir):
    return scoring.source_summary(_scored(spark, sf_dir), ["src"])


@query(f"""with {PAIRS}, s as (select sum({DIST_A})::double / sum(len(r)) as a, sum({DIST_B})::double / sum(len(r)) as b from p)
select 'a' as run_a, 'b' as run_b, (b - a) * 100 as difference, case when b < a then 'better' when b > a then 'worse' else 'equal' end as verdict from s""")
def run_difference(spark, sf_dir):
    return compare.run_difference(run_wer(spark, sf_dir))


@query(f"""with {PAIRS}, s as (select call_id, len(r) as n, {DIST_A} as d, {DIST_B} as e from p where len(r) > 0 and call_id is not null), c as (select call_id, sum(n) as n, sum(d) as d, sum(e)::double / sum(n) as o from s group by 1)
select count(*) as calls, sum(d)::double / sum(n) as new_wer, avg(o) as old_wer from c where call_id % 3 <> 0""")
def new_against_old_calls(spark, sf_dir):
    """Run a as the new scores; run b, without the calls divisible by three, as the old scores per call."""
    new = _scored(spark, sf_dir, "a").where("call_id is not null")
    old = scoring.corpus_wer(_scored(spark, sf_dir, "b").where("call_id is not null and call_id % 3 <> 0"), ["call_id"])
    return compare.old_and_new(new, old)


@query(f"""with {KNOWN}, h as (select distinct call_id from m where call_id % 5 <> 0), s as (select call_id, count(*) as n from m where call_id is not null and sentence is not null group by 1)
select count(*) filter (h.call_id is not null) as calls, count(*) filter (h.call_id is null) as unmatched_calls, coalesce(sum(n) filter (h.call_id is null), 0)::bigint as unmatched_samples from s left join h using (call_id)""")
def call_match_counts(spark, sf_dir):
    """Samples grouped by call against hypotheses of whole calls, which the calls divisible by five lack."""
    m = known_manifest(spark, sf_dir).where("call_id is not null and sentence is not null")
    hyps = known_manifest(spark, sf_dir).where("call_id % 5 <> 0").select("call_id").distinct()
    return scoring.match_counts(m, hyps, "call_id")


@query("select mark, count(*) as n from (select unnest(regexp_extract_all(sentence, '[‘’ʻʼ`´'']')) as mark from train) group by 1")
def apostrophe_variants(spark, sf_dir):
    return scoring.apostrophes(table(spark, sf_dir, "train").where("sentence is not null"), "sentence")


@query("""select event_type, round(100.0 * count(*) filter (value < 12) / greatest(count(*), 1), 1) as quiet_percent, sum(user_id)::double / greatest(sum(event_id), 1) as rtf, count(*) filter (user_id = 0) as without_factor from events group by 1""")
def realtime_factors(spark, sf_dir):
    """Events as jobs: event_id stands for seconds of audio, user_id for seconds of processing."""
    e = table(spark, sf_dir, "events")
    factor = stats.realtime_factor(F.col("event_id").cast("double"), F.col("user_id").cast("double"))
    return e.groupBy("event_type").agg(F.round(stats.percent(F.col("value") < 12), 1).alias("quiet_percent"), stats.ratio_of_sums(F.col("user_id").cast("double"), F.col("event_id").cast("double")).alias("rtf"), F.count_if(factor.isNull()).alias("without_factor"))


@query(f"""with {KNOWN}, c as (select path, length(sentence) / duration as x from m where duration > 0 and sentence is not null), h as (select path, x * 100 as hi, ((x * 134217729.0 - (x * 134217729.0 - x)) * 100 - x * 100) + (x - (x * 134217729.0 - (x * 134217729.0 - x))) * 100 as lo from c),
f as (select path, floor(hi) as w, hi - floor(hi) as rest, lo from h) select path, (w + case when rest > 0.5 or (rest = 0.5 and (lo > 0 or (lo = 0 and w % 2 = 1))) then 1 else 0 end) / 100.0 as cps from f""")
def rounded_cps(spark, sf_dir):
    """Characters per second to two digits, rounded as Python does."""
    m = known_manifest(spark, sf_dir).where("duration > 0 and sentence is not null")
    return m.select("path", stats.python_round(F.char_length("sentence") / F.col("duration"), 2).alias("cps"))
