"""Speech and telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.align import anchored_index, projected_roles
from ..functions.text import INVENTED, clean_repeats, sentence_ends, sentences, words
from ..operators import chunking, diarize, splits
from ..sources.tables import segments
from ..streaming import jobs
from .common import KNOWN, WORDS, known_manifest, table
from .queries import query

#: The text with a mark behind each . ! ? that blanks follow; RE2 has no look-behind.
MARKED = r"regexp_replace(sentence, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g')"
INVENTED_SQL = "'(?i)" + "|".join(f"(?:{x})" for x in INVENTED).replace("'", "''") + "'"

SEGS = "s as (select call_key, i - 1 as pos, segs[i] as g from (select distinct call_key, from_json(segments_json, '[{\"role\":\"VARCHAR\",\"speaker\":\"VARCHAR\",\"start\":\"DOUBLE\",\"end\":\"DOUBLE\",\"text\":\"VARCHAR\"}]') as segs, segments_json from transcripts where segments_json is not null), unnest(range(1, len(segs) + 1)) u(i))"
ROLE = "lower(trim(coalesce(g.role, g.speaker)))"


def _segments(spark, sf_dir):
    t = table(spark, sf_dir, "transcripts").where("segments_json is not null").select("call_key", "segments_json").distinct()
    d = segments(t).select("call_key", F.col("pos").cast("long").alias("pos"), F.col("seg.text").alias("text"), F.lower(F.trim(F.coalesce("seg.role", "seg.speaker"))).alias("role"), "seg.start", "seg.end")
    return d


@query(f"with {SEGS} select {ROLE} as role, count(*) as n from s group by 1")
def segment_roles(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


@query(f"""with {SEGS}, r as (select call_key, pos, {ROLE} as role from s),
f as (select call_key, pos, coalesce(last_value(role ignore nulls) over (partition by call_key order by pos rows unbounded preceding), first_value(role ignore nulls) over (partition by call_key order by pos rows between current row and unbounded following)) as role from r)
select call_key, pos, role from f""")
def role_forward_fill(spark, sf_dir):
    d = _segments(spark, sf_dir)
    return d.select("call_key", "pos", diarize.filled_roles(d, ["call_key"], ["pos"], "role").alias("role"))


@query(f"""with {SEGS}, r as (select call_key, pos, {ROLE} as role, g.text as text from s), c as (select *, row_number() over w = 1 or lag(role) over w is distinct from role as new from r window w as (partition by call_key order by pos))
select call_key, pos, md5(case when new then '[' || upper(coalesce(role, '?')) || '] ' || text else text end) as tagged_md5 from c""")
def role_change_tags(spark, sf_dir):
    d = diarize.role_tags(_segments(spark, sf_dir), ["call_key"], ["pos"], "role", "text")
    return d.select("call_key", "pos", F.md5("tagged").alias("tagged_md5"))


@query(f"""with {SEGS}, r as (select call_key, pos, {ROLE} as role from s), c as (select *, case when row_number() over w = 1 or lag(role) over w is distinct from role then 1 else 0 end as new from r window w as (partition by call_key order by pos)),
i as (select *, sum(new) over (partition by call_key order by pos rows unbounded preceding)::bigint as island from c) select call_key, island, count(*) as n from i group by 1, 2""")
def role_islands(spark, sf_dir):
    return diarize.islands(_segments(spark, sf_dir), ["call_key"], ["pos"], "role").groupBy("call_key", "island").agg(F.count("*").alias("n"))


TURNS = f"""{SEGS}, t as (select call_key, pos as turn_pos, g.start as s, g."end" as e, {ROLE} as speaker from s where g.start is not null and {ROLE} is not null),
w as (select call_key, i as pos, i * 4.0 + 0.5 as a, i * 4.0 + 0.95 as b from (select distinct call_key from t), unnest(range(0, 20)) u(i))"""


def _words(spark, sf_dir):
    """Twenty synthetic words per call, four seconds apart, and the call's timed segments as turns."""
    turns = _segments(spark, sf_dir).where("start is not null and role is not null").select("call_key", F.col("pos").alias("turn_pos"), "start", "end", F.col("role").alias("speaker"))
    w = turns.select("call_key").distinct().select("call_key", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    w = w.select("call_key", F.col("i").cast("long").alias("pos"), (F.col("i") * 4.0 + 0.5).alias("start"), (F.col("i") * 4.0 + 0.95).alias("end"), F.concat(F.lit("w"), F.col("i")).alias("word"))
    return diarize.nearest_turn(w, turns, "call_key")


@query(f"""with {TURNS}, d as (select w.call_key, w.pos, speaker, row_number() over (partition by w.call_key, w.pos order by case when (a + b) / 2 between s and e then 0.0 else least(abs((a + b) / 2 - s), abs((a + b) / 2 - e)) end, turn_pos) as k from w join t using (call_key))
select call_key, pos, speaker from d where k = 1""")
def word_to_speaker(spark, sf_dir):
    return _words(spark, sf_dir).select("call_key", "pos", "speaker")


@query(f"""with {TURNS}, d as (select w.call_key, w.pos, a, b, speaker, row_number() over (partition by w.call_key, w.pos order by case when (a + b) / 2 between s and e then 0.0 else least(abs((a + b) / 2 - s), abs((a + b) / 2 - e)) end, turn_pos) as k from w join t using (call_key)),
x as (select * from d where k = 1), c as (select *, case when pos = 0 or lag(speaker) over (partition by call_key order by pos) is distinct from speaker then 1 else 0 end as new from x),
i as (select *, sum(new) over (partition by call_key order by pos)::bigint as island from c), g as (select call_key, island, speaker, min(a) as "start", max(b) as "end", string_agg('w' || pos, ' ' order by pos) as text, count(*) as n_words from i group by 1, 2, 3),
l as (select call_key, speaker, row_number() over (partition by call_key order by min(island)) as k from g group by 1, 2)
select call_key, island, 'Speaker ' || l.k as label, "start", "end", text, n_words from g join l using (call_key, speaker)""")
def speaker_segments(spark, sf_dir):
    return diarize.renamed(diarize.segments(_words(spark, sf_dir), "call_key").withColumn("pos", F.col("island")), "call_key").select("call_key", "island", "label", "start", "end", "text", "n_words")


@query("""with r as (select *, row_number() over (partition by seller_id order by duration desc, db_call_id, start_time) as turn from (select distinct seller_id, db_call_id, duration, start_time from calls where seller_id is not null and duration between 60 and 300))
select db_call_id, seller_id, turn::int as turn from r order by turn, seller_id, db_call_id limit 30""")
def round_robin_sellers(spark, sf_dir):
    c = table(spark, sf_dir, "calls").where("seller_id is not null and duration between 60 and 300").select("seller_id", "db_call_id", "duration", "start_time").distinct()
    return splits.round_robin(c, "seller_id", [F.desc("duration"), "db_call_id", "start_time"], 30).select("db_call_id", "seller_id", "turn")


@query("""select db_call_id, seller_id from (select *, row_number() over (partition by seller_id order by duration desc, db_call_id, start_time) as k from (select distinct seller_id, db_call_id, duration, start_time from calls where seller_id is not null and duration between 60 and 300)) where k <= 12""")
def top_calls_per_seller(spark, sf_dir):
    c = table(spark, sf_dir, "calls").where("seller_id is not null and duration between 60 and 300").select("seller_id", "db_call_id", "duration", "start_time").distinct()
    return splits.top_per_group(c, "seller_id", [F.desc("duration"), F.col("db_call_id"), F.col("start_time")], 12).select("db_call_id", "seller_id")


@query("select label, count(distinct vec_id // 2) as n, max(len(embedding))::int as dims, 1.0 as norm from embeddings where embedding is not null and label is not null group by 1")
def voice_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("call", F.floor(F.col("vec_id") / 2))
    return diarize.voice_profiles(e, "label", "call", "embedding").select("label", "n", F.size("profile").alias("dims"), F.round(F.sqrt(diarize.dot(F.col("profile"), F.col("profile"))), 6).alias("norm"))


@query("""with x as (select label, unnest(range(1, len(embedding) + 1)) as i, embedding from embeddings where embedding is not null), m as (select label, i, avg(embedding[i]::double) as m from x group by 1, 2),
s as (select a.label as label_a, b.label as label_b, sum(a.m * b.m) as ab, sum(a.m * a.m) as aa, sum(b.m * b.m) as bb from m a join m b on a.i = b.i and a.label < b.label group by 1, 2)
select label_a, label_b, round(ab / greatest(sqrt(aa) * sqrt(bb), 1e-9), 6) as similarity from s""")
def centroid_similarity(spark, sf_dir):
    """Cosine of each pair of label centroids (bounded by the number of labels)."""
    c = diarize.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), F.round(diarize.cosine(F.col("a.centroid"), F.col("b.centroid")), 6).alias("similarity"))


@query("""with f as (select event_id, value < 12 as quiet, user_id from events), i as (select *, case when lag(quiet) over w is distinct from quiet then 1 else 0 end as new from f window w as (partition by user_id order by event_id)),
g as (select *, sum(new) over (partition by user_id order by event_id rows unbounded preceding) as island from i), r as (select user_id, island, min(event_id) as first_event, count(*) as n from g where quiet group by 1, 2) select user_id, first_event, n from r where n >= 3""")
def quiet_runs(spark, sf_dir):
    """Runs of at least three quiet events of a user: the islands that silence detection looks for in frames."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") < 12).alias("quiet"))
    i = diarize.islands(e, ["user_id"], ["event_id"], "quiet").where("quiet")
    return i.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).where("n >= 3").select("user_id", "first_event", "n")


@query()
def long_sample_plans(spark, sf_dir):
    """The second cut planner over all samples above 30 s; silences stand in every two seconds."""
    m = known_manifest(spark, sf_dir).where("duration > 30")
    runs = F.transform(F.sequence(F.lit(1), F.floor(F.col("duration") / 2).cast("int")), lambda i: F.struct((i * 2.0 - 0.2).alias("start"), (i * 2.0 + 0.2).alias("end")))
    p = m.select("path", chunking.planned(runs, sentence_ends(F.col("sentence")), F.col("sentence"), F.col("duration"), voiced=True).alias("p"))
    return p.select("path", F.size("p.pieces").alias("pieces"), "p.why")


@query(f"""with p as (select row_id, list_filter(list_transform(string_split_regex({MARKED}, '\\x01\\s+'), lambda x: trim(replace(x, chr(1), ''))), lambda x: x <> '') as p from train where sentence is not null),
r as (select row_id, list_filter(p, lambda x: not regexp_matches(x, {INVENTED_SQL})) as r from p)
select row_id, array_to_string(list_filter(r, lambda x, i: i = 1 or lower(x) <> lower(coalesce(r[i - 1], ''))), ' ') as cleaned from r""")
def cleaned_sentences(spark, sf_dir):
    return table(spark, sf_dir, "train").where("sentence is not null").select("row_id", clean_repeats(F.col("sentence")).alias("cleaned"))


@query(f"""with p as (select row_id, list_filter(list_transform(list_transform(string_split_regex({MARKED}, '\\x01\\s+'), lambda x: replace(x, chr(1), '')), lambda x: len({WORDS.format('x')})), lambda n: n > 0) as n from train where sentence is not null),
u as (select row_id, n, unnest(range(1, len(n) + 1)) as i from p) select row_id, (i - 1)::int as n, coalesce(list_sum(n[1:i - 1]), 0)::int as first_word, (coalesce(list_sum(n[1:i - 1]), 0) + n[i] - 1)::int as last_word from u""")
def indexed_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "train").where("sentence is not null").select("row_id", F.posexplode_outer(sentences(F.col("sentence"))).alias("n", "s")).where("s is not null")
    return d.select("row_id", "n", "s.first_word", "s.last_word")


@query("""select user_id, event_id, (count(*) filter (value >= 12) over (partition by user_id order by event_id rows unbounded preceding)) * 0.01 as voiced from events""")
def voiced_time(spark, sf_dir):
    """Events as frames of ten milliseconds: seconds of voice up to each one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") < 12).alias("quiet"))
    return chunking.voiced_until(e, ["user_id"], ["event_id"], "quiet", 0.01).select("user_id", "event_id", "voiced")


@query(f"""with {KNOWN}, c as (select path, duration, ceil(duration / 30)::int as n from m where duration > 30), k as (select *, unnest(range(1, n)) as i from c),
t as (select *, greatest(duration - 30.0 * (n - i), 0) as lo, least(30.0 * i, duration) as hi, duration * i / n as target from k),
s as (select t.*, list_filter(list_transform(range(1, floor(duration / 2)::int + 1), lambda j: {{'k': j, 'm': j * 2.0 + (j % 3) * 0.1, 'l': 0.4 + (j % 3) * 0.2}}), lambda r: abs(r.m - target) <= 4) as near from t),
f as (select *, list_filter(near, lambda r: r.l >= 0.8 * list_max(list_transform(near, lambda y: y.l)) - 1e-9) as fit from s)
select path, i::int as cut, round(lo, 4) as lo, round(hi, 4) as hi, round(list_min(list_transform(fit, lambda r: {{'d': round(abs(r.m - target), 6), 'k': r.k, 'm': r.m}})).m, 4) as silence from f""")
def cut_silences(spark, sf_dir):
    """For each cut of a long sample its feasible range and the silence that suits its equal share; silences stand in every two seconds."""
    m = known_manifest(spark, sf_dir).where("duration > 30").select("path", "duration", F.ceil(F.col("duration") / 30).cast("int").alias("n"))
    d = m.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))

    def run(j):
        middle, half = j * 2.0 + (j % 3) * 0.1, 0.2 + (j % 3) * 0.1
        return F.struct((middle - half).alias("start"), (middle + half).alias("end"))

    runs = F.transform(F.sequence(F.lit(1), F.floor(F.col("duration") / 2).cast("int")), run)
    r = chunking.feasible(F.col("duration"), F.col("i"), F.col("n"))
    s = chunking.nearest_silence(runs, F.col("duration") * F.col("i") / F.col("n"), F.lit(4.0))
    return d.withColumn("s", s).select("path", F.col("i").alias("cut"), F.round(r["lo"], 4).alias("lo"), F.round(r["hi"], 4).alias("hi"), F.round((F.col("s.start") + F.col("s.end")) / 2, 4).alias("silence"))


@query("""with e as (select row_id, length(sentence) as n, list_transform(range(1, length(sentence) // 17 + 1), lambda j: j * 17) as b from train where sentence is not null),
t as (select *, n / 2.0 as target, list_filter(b, lambda x: x > n // 4 and abs(x - n / 2.0) <= 12) as near from e),
g as (select *, list_filter(b[1:len(b) - 1], lambda x: x between n * 0.3 and n * 0.7) as inside from t)
select row_id, list_min(list_transform(near, lambda x: {'d': abs(x - target), 'x': x})).x::int as bound, list_min(list_transform(inside, lambda x: {'d': abs(x - target), 'x': x})).x::int as seg_end from g""")
def nearest_cuts(spark, sf_dir):
    """Boundaries every 17 characters: the one nearest to the middle behind the first quarter, and the segment end nearest to it."""
    t = table(spark, sf_dir, "train").where("sentence is not null").select("row_id", F.char_length("sentence").alias("n"))
    k = F.floor(F.col("n") / 17).cast("int")
    b = F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda j: j * 17)).otherwise(F.array().cast("array<int>"))
    d = t.withColumn("b", b).withColumn("target", F.col("n") / 2)
    bound = chunking.nearest_bound(F.col("b"), F.col("target"), F.lit(12), F.floor(F.col("n") / 4))
    return d.select("row_id", bound.alias("bound"), chunking.nearest_end(F.col("b"), F.col("target"), F.col("n") * 0.3, F.col("n") * 0.7).alias("seg_end"))


@query("""with w as (select row_id, len(string_split(trim(sentence), ' ')) as n from train where sentence is not null), i as (select *, unnest(range(0, n)) as i from w),
a as (select *, (i // 9) * 9 as before, case when ((i + 8) // 9) * 9 < n then ((i + 8) // 9) * 9 end as after from i),
f as (select *, case when after is null or i - before <= after - i then i - before else after - i end as d from a)
select row_id, i::int as word, case when d <= 3 then (case when after is null or i - before < after - i then before + before // 9 + i - before
  when after - i < i - before then after + after // 9 + i - after else least(before + before // 9 + i - before, after + after // 9 + i - after) end)::int end as ref from f""")
def anchored_words(spark, sf_dir):
    """An anchor at every ninth word, each one shifted by one more: the index that each word has in the reference, if an anchor is near."""
    t = table(spark, sf_dir, "train").where("sentence is not null").select("row_id", F.size(F.split(F.trim("sentence"), " ")).alias("n"))
    anchors = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 9).cast("int")), lambda k: F.struct((k * 9).alias("hyp"), (k * 10).alias("ref")))
    d = t.withColumn("a", anchors).withColumn("word", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return d.select("row_id", "word", anchored_index(F.col("a"), F.col("word")).alias("ref"))


@query(f"""with {SEGS}, r as (select call_key, pos, {ROLE} as role, {WORDS.format('g.text')} as w from s), c as (select call_key, sum(len(w)) as n from r where role is not null group by 1)
select count(*) as pieces, count(*) as with_turns, 1.0 as least_match from c where n >= 4""")
def role_projection(spark, sf_dir):
    """The first half of each call's words, as a piece, with the roles of the call's words: all of them are found."""
    s = _segments(spark, sf_dir).where("role is not null").select("call_key", "pos", "role", words(F.col("text")).alias("w"))
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "w"))), lambda x: F.transform(x["w"], lambda w: F.struct(w.alias("word"), x["role"].alias("role")))))
    c = s.groupBy("call_key").agg(tokens.alias("t")).where(F.size("t") >= 4)
    piece = F.array_join(F.transform(F.slice("t", F.lit(1), F.floor(F.size("t") / 2).cast("int")), lambda x: x["word"]), " ")
    p = c.select(projected_roles(piece, F.col("t")).alias("p"))
    return p.agg(F.count("*").alias("pieces"), F.count("p.turns").alias("with_turns"), F.round(F.min("p.role_match"), 6).alias("least_match"))


STATUS = "case event_type when 'error' then 'FAILED' when 'purchase' then 'COMPLETED' else 'IN_PROGRESS' end"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("IN_PROGRESS")
    return e.select(F.floor(F.col("event_id") / 3).alias("id"), "event_id", F.col("ts").alias("at"), status.alias("status"), F.lit(None).cast("string").alias("out_status"), F.when(F.col("user_id") % 4 != 0, F.col("value")).alias("duration_sec"), (F.col("value") / 10).alias("processing_time_sec"), (F.col("user_id") * 10).cast("double").alias("delay_ms"), (F.col("user_id") % 20).cast("string").alias("agent"))


@query(f"""select event_id // 3 as id, arg_max({STATUS}, event_id) as status, arg_max(value, event_id) filter (user_id % 4 <> 0) as duration_sec, count(*) as patches from events group by 1""")
def job_last_state(spark, sf_dir):
    s = jobs.last_state(_events(spark, sf_dir), "id", "at", ["status", "duration_sec"], "event_id")
    return s.select("id", "status", "duration_sec", "patches")


@query(f"""with f as (select event_id // 3 as id, {STATUS} as status, ts, user_id, row_number() over (partition by event_id // 3 order by ts, event_id) as k from events where event_type in ('error', 'purchase'))
select strftime(ts, '%Y-%m-%d') as day, count(*) as jobs, count(*) filter (status <> 'COMPLETED') as errors, sum(user_id)::bigint as queue_centisec from f where k = 1 group by 1""")
def job_daily_stats(spark, sf_dir):
    f = jobs.finished_once(_events(spark, sf_dir), "id", "at", "event_id")
    return jobs.daily_stats(f, "at").select("day", "jobs", "errors", F.round(F.col("queue_sec") * 100).cast("long").alias("queue_centisec"))


@query("""with p as (select strftime(ts, '%Y-%m-%d') as day, (user_id % 20)::varchar as source, count(*) as n, min((ts, event_id)) as f from events group by 1, 2), r as (select *, row_number() over (partition by day order by f, source) as k from p)
select day, case when k <= 12 then source else 'boshqa' end as source, sum(n)::bigint as n from r group by 1, 2""")
def source_counters(spark, sf_dir):
    from ..functions.text import day_key

    e = jobs.agents(_events(spark, sf_dir), "agent").withColumn("day", day_key(F.col("at")))
    return jobs.bounded_counter(e, "day", "source", "at", "event_id")


@query("select event_id // 3 as id, max(ts) as at from events group by 1 order by max(ts) desc, 1 limit 200")
def job_feed(spark, sf_dir):
    return jobs.feed(jobs.last_state(_events(spark, sf_dir), "id", "at", ["status"], "event_id"), "at", "id").select("id", "at")


@query("""with s as (select db_call_id, coalesce(direction, '?') as direction, duration from (select distinct db_call_id, direction, duration from calls)), t as (select distinct call_key, try_cast(nullif(regexp_extract(call_key, '^x:([0-9]+)', 1), '') as bigint) as db_call_id from transcripts)
select direction, count(*) as transcripts from t join s using (db_call_id) group by 1""")
def transcripts_by_direction(spark, sf_dir):
    c = table(spark, sf_dir, "calls").select("db_call_id", F.coalesce("direction", F.lit("?")).alias("direction"), "duration")
    c = c.select("db_call_id", F.col("direction"), "duration").distinct()
    t = table(spark, sf_dir, "transcripts").select("call_key").distinct().withColumn("db_call_id", F.nullif(F.regexp_extract("call_key", r"^x:(\d+)", 1), F.lit("")).try_cast("long"))
    return t.join(c, "db_call_id").groupBy("direction").agg(F.count("*").alias("transcripts"))


@query("""with r as (select distinct call_key from transcripts where segments_json is not null and call_key not like '%:p%' and segments_json like '%"role": "%')
select path from (select distinct path, call_id from manifest where part is null and call_id is not null) m where 'x:' || call_id in (select call_key from r)""")
def edited_wholes(spark, sf_dir):
    """Whole samples of calls whose transcript carries roles."""
    t = table(spark, sf_dir, "transcripts").where("call_key not like '%:p%'").select("call_key", "segments_json").distinct()
    roled = segments(t).where("seg.role is not null").select("call_key").distinct()
    m = table(spark, sf_dir, "manifest").where("part is null and call_id is not null").select("path", "call_id").distinct()
    return m.withColumn("call_key", F.concat(F.lit("x:"), F.col("call_id"))).join(roled, "call_key", "left_semi").select("path")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as events from events where strftime(ts, '%Y-%m-%d') between '2024-01-03' and '2024-01-20' group by 1")
def events_in_range(spark, sf_dir):
    from ..functions.text import day_key

    e = table(spark, sf_dir, "events").withColumn("day", day_key(F.col("ts")))
    return e.where(F.col("day").between("2024-01-03", "2024-01-20")).groupBy("day").agg(F.count("*").alias("events"))


@query(f"""with d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as jobs from events group by 1) select * from d where day::date > date '2024-05-10' - 120""")
def kept_daily_stats(spark, sf_dir):
    """Daily counts that haven't expired on the tenth of May 2024, from the oldest on."""
    from ..functions.text import day_key

    d = table(spark, sf_dir, "events").groupBy(day_key(F.col("ts")).alias("day")).agg(F.count("*").alias("jobs"))
    return jobs.by_day(jobs.unexpired(d, "day", "2024-05-10"))


@query("select case when strlen(text) > 4096 then 'too_big' else 'stored' end as kind, count(*) as n, sum(strlen(text))::bigint as bytes from documents where text is not null group by 1")
def storable_kinds(spark, sf_dir):
    """Documents as stored bytes with a bound of 4096."""
    d = jobs.storable(table(spark, sf_dir, "documents").where("text is not null"), "text", 4096)
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
