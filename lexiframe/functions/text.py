"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Apostrophes that count as one letter.
APOSTROPHES = "‘’ʻʼ`´"
APOSTROPHES_SHORT = "‘’ʻ`"
# Lexicons of the spelling rules.
SPELLINGS = {
    "ha": ["hm", "hmm", "ha", "aha", "ahaa", "aa", "ah", "xa", "he", "ehe", "mhm", "uhu"],
    "alaykum": ["vaalaykum", "valaykum", "vaalayqum", "alaykum", "aleykum", "alaykm"],
    "assalom": ["assalomu", "assalom", "salom", "assalamu"],
    "alo": ["allo", "alo", "alyo", "allyo"],
    "xo'p": ["xo'p", "xop", "hop", "ho'p"],
    "yo'q": ["yo'q", "yoq", "yo"],
}
DIGIT_WORDS = {"0": "nol", "1": "bir", "2": "ikki", "3": "uch", "4": "to'rt", "5": "besh", "6": "olti", "7": "yetti", "8": "sakkiz", "9": "to'qqiz", "10": "o'n", "100": "yuz", "1000": "ming"}
# Sentences that a recogniser invents.
INVENTED = (r"^\W*(obuna bo['‘’]?ling[^.!?]*)[.!?]?\W*$", r"^\W*(subscribe|thanks? for watching)[^.!?]*[.!?]?\W*$", r"^\W*(продолжение следует)[^.!?]*[.!?]?\W*$")
# Domain terms.
DOMAIN_TERMS = ["face", "id", "davomat", "xodim", "apparat", "kontrol", "shartnoma", "buxgalteriya", "hr", "plyus", "dastur", "zapravka", "lokatsiya", "ustanovka", "tarif", "litsenziya"]


def norm(s: Column) -> Column:
    """Canonical text: apostrophes made one, small letters, everything but letters, digits, _ and ' a blank, blanks collapsed. Null stays."""
    plain = F.lower(F.translate(s, APOSTROPHES, "'" * len(APOSTROPHES)))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s']", " "), r"\s+", " "))


def words(s: Column) -> Column:
    """Words of the canonical text; an empty text has none."""
    return F.filter(F.split(norm(s), " "), lambda w: w != "")


def norm_word(w: Column, short: bool = False) -> Column:
    """One word with everything but letters, digits, _ and ' deleted. short: the variant that knows four of the six apostrophes."""
    marks = APOSTROPHES_SHORT if short else APOSTROPHES
    return F.regexp_replace(F.lower(F.translate(w, marks, "'" * len(marks))), r"[^\p{L}\p{N}_']", "")


def raw_words(s: Column) -> Column:
    """Tokens between blanks, as they stand."""
    return F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")


def call_id_of(path: Column) -> Column:
    """Leading digits of the file name; null without."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(\d+)", 1), F.lit("")).try_cast("long")


def order_key(path: Column, default_part: int = 1) -> Column:
    """part * 100 + slice of a file name like 15286_p1_s2.flac; a missing part is default_part (1 or 0), a missing slice 0."""
    part = F.nullif(F.regexp_extract(path, r"_p(\d+)", 1), F.lit("")).try_cast("int")
    piece = F.nullif(F.regexp_extract(path, r"_s(\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(part, F.lit(default_part)) * 100 + F.coalesce(piece, F.lit(0))


def cps(text: Column, duration: Column) -> Column:
    """Characters per second; 0 for a duration of 0, null for an unknown one."""
    return F.when(duration == 0, F.lit(0.0)).otherwise(F.try_divide(F.char_length(text).cast("double"), duration))


def first_text(cols: list[Column]) -> Column:
    """The first text that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def sentence_ends(text: Column) -> Column:
    """Offsets behind runs of . ! ? … with the blanks (also U+00A0) that follow; a mark without a blank behind it ends nothing."""
    parts = F.regexp_extract_all(text, F.lit(r"\G([\s\S]*?[.!?…]+[\s\x{A0}]+)"), F.lit(1))
    return F.slice(F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(p)))), 2, F.size(parts) + 1)


def sentences(text: Column) -> Column:
    """array<struct<sentence, first_word, last_word>>: split behind . ! ? and blanks, with the running index of canonical words; sentences
    without words are dropped."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.size(words(s)) > 0)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<sentence: string, first_word: int, last_word: int>>)").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        n = F.size(words(s))
        row = F.struct(F.trim(s).alias("sentence"), acc["at"].alias("first_word"), (acc["at"] + n - 1).alias("last_word"))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(parts, zero, add, lambda acc: acc["out"])


def clean_repeats(text: Column) -> Column:
    """Drops invented sentences, then sentences that repeat the last kept one in any case."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda p: p != "")
    real = F.filter(parts, lambda p: ~reduce(lambda a, b: a | b, [p.rlike("(?iu)" + rx) for rx in INVENTED]))
    keep = F.filter(real, lambda p, i: (i == 0) | (F.lower(p) != F.lower(F.coalesce(F.get(real, i - 1), F.lit("")))))
    return F.array_join(keep, " ")


def spell(w: Column) -> Column:
    """Orthographic canon of a word: lexicon first, else repeated letters collapsed."""
    table = {x: to for to, xs in SPELLINGS.items() for x in xs} | DIGIT_WORDS
    lexicon = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(lexicon, w), F.regexp_replace(w, r"(.)\1+", "$1"))


def longest_repeat(ws: Column) -> Column:
    """Length of the longest run of one word in a row."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(w == acc["last"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(ws, zero, step, lambda acc: acc["best"])


def repeated_trigrams(ws: Column) -> Column:
    """How many three-word sequences stand more than once, counting each further one."""
    grams = F.when(F.size(ws) >= 3, F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.array_join(F.slice(ws, i, F.lit(3)), " "))).otherwise(F.array().cast("array<string>"))
    return F.size(grams) - F.size(F.array_distinct(grams))


def content_type(data: Column) -> Column:
    """Media type from the first bytes; fewer than 12 bytes tell nothing."""
    h = F.hex(F.substring(data, 1, 12))
    b1 = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    sync = F.substring(h, 1, 2).eqNullSafe("FF") & (b1.bitwiseAND(0xE0) == 0xE0)
    return (
        F.when(F.octet_length(data) < 12, "application/octet-stream")
        .when((F.substring(h, 1, 8) == "52494646") & (F.substring(h, 17, 8) == "57415645"), "audio/wav")
        .when(F.substring(h, 1, 8) == "664C6143", "audio/flac")
        .when(F.substring(h, 1, 8) == "4F676753", "audio/ogg")
        .when(F.substring(h, 9, 8) == "66747970", "audio/mp4")
        .when(F.substring(h, 1, 6) == "494433", "audio/mpeg")
        .when(sync & (b1.bitwiseAND(0x16) == 0x10), "audio/aac")
        .when(sync, "audio/mpeg")
        .otherwise("application/octet-stream")
    )


def byte_range(header: Column, total: Column) -> Column:
    """struct<status, start, end> of a range header like bytes=a-b, bytes=a- or bytes=-n: 206 with the span, 416 if it can't be met, 200
    with the whole for anything else."""
    h = F.trim(header)
    ok = h.rlike(r"^bytes=(\d*)-(\d*)$")
    a = F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-", 1), F.lit("")).try_cast("long")
    b = F.nullif(F.regexp_extract(h, r"-(\d*)$", 1), F.lit("")).try_cast("long")
    start = F.when(a.isNull(), F.greatest(F.lit(0), total - F.coalesce(b, F.lit(0)))).otherwise(a)
    end = F.when(a.isNull() | b.isNull() | (b >= total), total - 1).otherwise(b)
    bad = (start > end) | (start >= total)
    whole = F.struct(F.lit(200).alias("status"), F.lit(0).cast("long").alias("start"), (total - 1).cast("long").alias("end"))
    part = F.struct(F.when(bad, 416).otherwise(206).alias("status"), F.when(~bad, start).cast("long").alias("start"), F.when(~bad, end).cast("long").alias("end"))
    return F.when(F.coalesce(ok, F.lit(False)), part).otherwise(whole)


def source_key(agent: Column, missing: str = "(none)") -> Column:
    """First 48 characters of a trimmed user agent."""
    return F.coalesce(F.nullif(F.substring(F.trim(agent), 1, 48), F.lit("")), F.lit(missing))


def day_key(ts: Column) -> Column:
    """Day of a time in the session's zone (UTC), as text."""
    return F.date_format(ts, "yyyy-MM-dd")


def valid_job_id(x: Column) -> Column:
    return x.rlike(r"^[a-zA-Z0-9-]{8,80}$")


def hashed_rank(key: Column, seed: int) -> Column:
    """A random order that every engine can repeat: 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast(T.StringType()))), 1, 8), 16, 10).cast("long")
