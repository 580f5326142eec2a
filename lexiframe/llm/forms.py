"""Problem 3: text that looks the same but differs in its characters.

Method: distinct texts are exploded to positioned code points, the code points are joined with broadcast tables of decompositions
and look-alikes, combining marks are put in the order of their classes, clusters are recomposed and the strings rebuilt.

The exploded code points never cross the network: the texts are hash-partitioned by their key before they are exploded, Spark keeps
that partitioning through the generator and the broadcast joins, and the rebuilding aggregation needs the same one.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters of other alphabets drawn like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "ү": "y", "Ү": "Y", "ѵ": "v", "Ѵ": "V", "ӏ": "l", "Ӏ": "I", "օ": "o", "հ": "h", "ս": "u", "ո": "n", "ɡ": "g", "ɑ": "a", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Apostrophes, hyphens and invisible characters.
APOSTROPHES = "\u0060\u00b4\u2018\u2019\u201b\u02bb\u02bc\u02b9\u02c8\u2032\uff07\uff40"
HYPHENS = "\u2010\u2011\u2012\u2013\u2212\ufe63\uff0d"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
BLANKS = "\u0009\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Compatibility kinds of Unicode whose glyphs differ from the plain letters'; these stay as they are.
VISIBLE_KINDS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<noBreak>", "<font>")


def _one(cp: int) -> str:
    """What one code point becomes before marks are ordered: decomposed, of one width, blank, hyphen, apostrophe and look-alike."""
    ch = chr(cp)
    if ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F:
        return ""
    if ch in BLANKS:
        return " "
    if ch in APOSTROPHES:
        return "'"
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.decomposition(ch)
    if kind.startswith(VISIBLE_KINDS):
        return ch
    flat = unicodedata.normalize("NFKD" if kind.startswith("<") else "NFD", ch)
    if kind.startswith("<compat>") and " " in flat:  # spacing marks are no blank with a mark
        return ch
    return "".join(LOOK_ALIKES.get(x, x) for x in flat)


VOWEL, FINAL = range(0x1161, 0x1176), range(0x11A8, 0x11C3)  #: jamo that join the syllable before them


@lru_cache(1)
def mapping_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, the code points it becomes with their combining classes) for each one that doesn't stay as it is. Bounded by
    Unicode. Vowel and final jamo get the classes 1 and 2, so that they join their syllable."""
    rows = [(chr(c), [(chr(c), k)]) for k, jamo in ((1, VOWEL), (2, FINAL)) for c in jamo]
    for cp in [0x09, 0x60, *range(0x80, sys.maxunicode + 1)]:
        if 0xAC00 <= cp < 0xF900 or cp in VOWEL or cp in FINAL:  # Hangul syllables stay whole; surrogates; private use
            continue
        to = _one(cp)
        if to != chr(cp) or unicodedata.combining(chr(cp)):
            rows.append((chr(cp), [(x, (x in map(chr, VOWEL)) + 2 * (x in map(chr, FINAL)) or unicodedata.combining(x)) for x in to]))
    return rows


@lru_cache(1)
def composition_rows() -> list[tuple[str, str]]:
    """(decomposed cluster, composed cluster) for each code point that Unicode composes, and for syllables with a final jamo behind them."""
    rows: dict[str, str] = {}
    for cp in [*range(0xA0, 0xD7A4), *range(0xF900, sys.maxunicode + 1)]:
        ch = chr(cp)
        flat = unicodedata.normalize("NFD", ch)
        if flat != ch:
            flat = "".join(LOOK_ALIKES.get(x, x) for x in flat)
            whole = unicodedata.normalize("NFC", flat)
            if whole != flat:
                rows[flat] = whole
                if len(flat) == 3 and 0xAC00 <= cp <= 0xD7A3:
                    rows[unicodedata.normalize("NFC", flat[:2]) + flat[2]] = whole
    return sorted(rows.items())


@lru_cache(1)
def pair_rows() -> dict[str, str]:
    """Letter and mark -> composed letter, for the clusters that are no composition as a whole."""
    out = {}
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, sys.maxunicode + 1)]:
        two = unicodedata.decomposition(chr(cp)).split()
        if len(two) == 2 and "<" not in two[0]:
            flat = "".join(chr(int(x, 16)) for x in two)
            if unicodedata.normalize("NFC", flat) == chr(cp):
                out[flat] = chr(cp)
    return out


def composed(marks: Column) -> Column:
    """The string of array<struct<cc, at, ch>> in the order of classes: each mark composes with what its letter has become, unless a mark
    of its class that composed with nothing stands before it."""
    pairs = F.from_json(F.lit(json.dumps(pair_rows())), "map<string,string>")
    zero = F.struct(F.get(marks, 0)["ch"].alias("s"), F.lit("").alias("tail"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        both = F.element_at(pairs, F.concat(acc["s"], x["ch"]))
        joins = both.isNotNull() & (x["cc"] > acc["last"])
        return F.struct(F.when(joins, both).otherwise(acc["s"]).alias("s"), F.when(joins, acc["tail"]).otherwise(F.concat(acc["tail"], x["ch"])).alias("tail"), F.when(joins, acc["last"]).otherwise(x["cc"]).alias("last"))

    return F.aggregate(F.slice(marks, F.lit(2), F.size(marks)), zero, step, lambda acc: F.concat(acc["s"], acc["tail"]))


_made: dict[str, tuple[DataFrame, DataFrame]] = {}


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    app = spark.sparkContext.applicationId
    if app not in _made:
        maps = spark.createDataFrame(mapping_rows(), "cp string, to array<struct<ch: string, cc: int>>")
        comps = spark.createDataFrame(composition_rows(), "cluster string, whole string")
        _made.clear()
        _made[app] = (F.broadcast(maps), F.broadcast(comps))
    return _made[app]


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text in groupings, so that long texts aren't carried along."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def canonical_texts(df: DataFrame, text: str) -> DataFrame:
    """One row (k1, k2, text, form) per distinct non-null text.

    A run of ASCII that no table changes is one element, every other code point an element of its own. Null texts give no row, empty
    ones an empty form. Marks with equal class keep their order. A mark without a base stays alone.
    """
    maps, comps = _tables(df.sparkSession)
    t = F.col("_t")
    uniq = df.select(F.col(text).alias("_t")).where(t.isNotNull()).select(*text_key(t), "_t").groupBy("k1", "k2").agg(F.first("_t").alias("_t"))
    elements = F.regexp_extract_all(t, F.lit(r"([ -_a-~]+(?![^ -~])|[\s\S])"), F.lit(1))
    cps = uniq.select("k1", "k2", F.posexplode_outer(elements).alias("pos", "cp")).where("cp is not null")  # outer: else a filter on the size computes all twice
    same = F.array(F.struct(F.col("cp").alias("ch"), F.lit(0).alias("cc")))
    mapped = cps.join(maps, "cp", "left").select("k1", "k2", "pos", F.posexplode_outer(F.coalesce("to", same)).alias("sub", "x")).where("x is not null")
    at = F.col("pos").cast("long") * 64 + F.col("sub")
    ordered = Window.partitionBy("k1", "k2").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    based = mapped.select("k1", "k2", at.alias("at"), "x.ch", "x.cc", F.max(F.when(F.col("x.cc") == 0, at)).over(ordered).alias("base"))
    clusters = based.groupBy("k1", "k2", "base").agg(F.array_sort(F.collect_list(F.struct("cc", "at", "ch"))).alias("marks"), F.min("at").alias("at"))
    clusters = clusters.withColumn("cluster", F.array_join(F.transform("marks", lambda x: x["ch"]), ""))
    part = clusters.join(comps, "cluster", "left")
    piece = F.coalesce("whole", F.when((F.size("marks") > 2) & ~F.col("cluster").rlike("^[ -~]*$"), composed(F.col("marks"))), "cluster")
    forms = part.select("k1", "k2", "at", piece.alias("c")).groupBy("k1", "k2").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]), "").alias("form")
    )
    return uniq.join(forms, ["k1", "k2"], "left").select("k1", "k2", F.col("_t").alias("text"), F.coalesce("form", F.lit("")).alias("form"))


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """df with the canonical form of a text column; null stays null. Rows join their text's form by its key, which AQE splits where one
    text holds many rows."""
    forms = canonical_texts(df, text).select("k1", "k2", F.col("form").alias("_form"))
    k1, k2 = (c for c in text_key(F.col(text)))
    return df.withColumn("_k1", k1).withColumn("_k2", k2).join(forms.toDF("_k1", "_k2", form), ["_k1", "_k2"], "left").drop("_k1", "_k2")


def same_looking_rows(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, class_id, n_variants): one row per row whose text has variants, texts that look identical but differ as strings. class_id
    stands for the common form. Nothing is paired, so a stock phrase costs no more than its rows."""
    forms = canonical_texts(df, text).select(F.xxhash64("form").alias("class_id"), F.xxhash64("form", F.lit(1)).alias("c2"), "k1", "k2")
    several = forms.groupBy("class_id", "c2").agg(F.count("*").alias("n_variants")).where("n_variants > 1")
    texts = forms.join(several, ["class_id", "c2"])
    return df.where(F.col(text).isNotNull()).select(row_id, *text_key(F.col(text))).join(texts, ["k1", "k2"]).select(row_id, "class_id", "n_variants")


def same_looking_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id_a, row_id_b): pairs of rows whose texts look identical but differ as strings.

    Variants are paired per distinct string, so that rows with the very same string never meet each other. Rows with a null id or text
    are in no pair; an id that stands on several rows pairs each of its texts.
    """
    forms = canonical_texts(df, text)
    variants = forms.select(F.xxhash64("form").alias("f1"), F.xxhash64("form", F.lit(1)).alias("f2"), "k1", "k2", "text")
    several = variants.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    several = variants.join(several, ["f1", "f2"], "left_semi").select("f1", "f2", "k1", "k2")
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("_t")).where("id is not null and _t is not null").select("id", *text_key(F.col("_t")))
    rows = rows.join(several, ["k1", "k2"])
    a, b = rows.alias("a"), rows.alias("b")
    differ = (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2")) & (F.col("a.id") < F.col("b.id"))
    differ = differ & ((F.col("a.k1") != F.col("b.k1")) | (F.col("a.k2") != F.col("b.k2")))
    return a.join(b, differ).select(F.col("a.id").alias("row_id_a"), F.col("b.id").alias("row_id_b")).distinct()
