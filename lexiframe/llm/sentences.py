"""Problem 2: sentence units of texts in any language or script.

Method: all in SQL expressions. Dots of numbers, addresses, initials and abbreviations, and the end marks inside quotations are masked
with private-use characters, the text is split behind the end marks of its script, and positions are counted on the masked text, which
has as many characters as the original; a unit's text is then cut from the original.

The plan is one projection and a generator: it neither shuffles nor leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import APOSTROPHES, BLANKS, LOOK_ALIKES

DOT, ENDED, INNER, CUT = "", "", "", ""
OPEN, CLOSE = "", ""
GLUE = r"[\p{M}\p{Cf}]{0,4}"
QUOTE_MAX = 1000  #: a quotation longer than this is read as plain text, so that a lone quote can't swallow a document
BLOCK = 256  #: units are numbered in blocks of this many, so that counting stays linear in the length of a text

# Abbreviations behind which a sentence goes on.
ABBREVIATIONS = (
    "prof dots b.t kv tel to'lq tolq k mln mlrd tum sh проф доц кв тел ул руб т.е г гр им стр рис см млн млрд пр обл b.n dr mr mrs ms st vs no nr "
    "i.e e.g approx fig jr sr av avda mme mlle m p env cf art vol bzw ca str vb yy tp ts π.χ κ κα δηλ डॉ श्री सुश्री प्रो"
).split()
# Titles that stand before a name.
TITLES = "Gen Sgt Lt Col Maj Capt Gov".split()
# Abbreviations of two words with a dot each.
TWO_PART = (("z", "B"), ("d", "h"), ("u", "a"), ("p", "ex"), ("т", "к"), ("т", "е"))
# Abbreviations that may also end a sentence; they do if the next word has a capital letter.
CLOSING_ABBREVIATIONS = "h.k ҳ.к т.д т.п др etc usw vs.b κ.λπ κ.ά".split()
# Months behind an ordinal number with a dot.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# End marks that end a unit wherever they stand (the dot and the ellipsis are treated apart).
MARKS = "!?。！？｡॥।؟۔።፧፨։។៕៖။‼⁇⁈⁉"
LINE_ENDS = "\u000b\u000c\u000d\u0085  "


def _abbreviation_pattern(words: list[str]) -> str:
    """Alternatives for the folded words; letters may have invisible characters between them, and the last dot is left to the caller."""
    folded = ["".join(LOOK_ALIKES.get(c, c) for c in w) for w in sorted(words, key=len, reverse=True)]
    return "(?:" + "|".join("".join((f"[.{DOT}]" if c == "." else re.escape(c)) + GLUE for c in w) for w in folded) + ")"


def _folded(text: Column) -> Column:
    """The text with one character for each of its characters: blanks, line ends, full width, apostrophes and look-alike letters made
    plain."""
    src = BLANKS + LINE_ENDS + APOSTROPHES + "".join(LOOK_ALIKES) + "｢｣" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    dst = " " * len(BLANKS) + "\n" * len(LINE_ENDS) + "'" * len(APOSTROPHES) + "".join(LOOK_ALIKES.values()) + "「」" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    seen: dict[str, str] = {}
    for a, b in zip(src, dst, strict=True):
        seen.setdefault(a, b)
    return F.translate(text, "".join(seen), "".join(seen.values()))


def _stages(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the folded text with CUT behind each unit as a column; all other characters stand one for one for those of the text.

    Each conditional step is a projection of its own: Catalyst keeps them apart, and no expression is evaluated twice.
    """
    r = F.regexp_replace
    raw, t = F.col(text), F.col(out)
    not_word = rf"(?<![\p{{L}}\p{{N}}'\p{{M}}{DOT}])"
    alone = r"(?<![\p{L}\p{N}'\p{M}])"
    df = df.withColumn(out, _folded(raw))
    # addresses as a whole: every end mark that something of the address follows
    address = rf"(?:(https?://|www(?=\.))|(?<!^)\G)([^\s{MARKS}.…]*)[{MARKS}.…](?=[\p{{L}}\p{{N}}/&=#%_~?.-])"
    df = df.withColumn(out, F.when(raw.rlike(r"(?i)https?://|www\."), r(t, "(?i)" + address, f"$1$2{DOT}")).otherwise(t))
    # numbers, versions, addresses: a dot between digits, or between a letter or digit and a small letter or digit
    s = r(t, rf"(?<=\p{{N}}{GLUE})\.(?={GLUE}\p{{N}})", DOT)
    s = r(s, rf"(?<=[\p{{L}}\p{{N}}]{GLUE})\.(?={GLUE}[\p{{Ll}}\p{{N}}])", DOT)
    # names like Node.JS, titles before a name
    s = r(s, r"(?<=\p{Lu}\p{Ll}{1,12})\.(?=\p{Lu}{2,4}(?!\p{L}))", DOT)
    s = r(s, rf"{not_word}((?:{'|'.join(TITLES)}))\.(?= \p{{Lu}})", rf"$1{DOT}")
    # initials: capital letters that stand alone, or two small ones
    s = r(s, rf"{alone}(\p{{Lu}}{GLUE})\.", rf"$1{DOT}")
    s = r(s, rf"{not_word}(\p{{Ll}}{GLUE})[.{DOT}] (\p{{Ll}}{GLUE})[.{DOT}](?= ?{GLUE}\p{{L}})", rf"$1{DOT} $2{DOT}")
    s = r(s, rf"{not_word}((?iu){_abbreviation_pattern(ABBREVIATIONS)})\.", rf"$1{DOT}")
    for a, b in TWO_PART:
        s = r(s, rf"{not_word}((?iu){_abbreviation_pattern([a])})[.{DOT}]( ?)((?iu){_abbreviation_pattern([b])})[.{DOT}]", rf"$1{DOT}$2$3{DOT}")
    s = r(s, rf"{not_word}(\p{{N}}{{1,2}})\.(?= (?:{'|'.join(MONTHS)}))", rf"$1{DOT}")
    df = df.withColumn(out, s)
    closing = r(t, rf"{not_word}((?iu){_abbreviation_pattern(CLOSING_ABBREVIATIONS)})\.(?= ?{GLUE}\p{{Ll}})", rf"$1{DOT}")
    df = df.withColumn(out, F.when(raw.rlike(r"\p{Lu}"), closing).otherwise(t))
    # an ellipsis that a small letter follows
    s = r(t, rf"(?:(?<=[.…{DOT}])\.|\.(?=[.…])|…)(?=[.…]{{0,8}} *{GLUE}\p{{Ll}})", DOT)
    # quotes: opening ones stand at the start or behind a blank or bracket and before a character, or are so by their form
    s = r(s, r"[「『„‚]", OPEN)
    s = r(s, r"[」』”]", CLOSE)
    cjk = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}。！？，、"
    s = r(s, rf"(?<=^|[\s(\[{cjk}])[“«»\"](?=\S)|(?<=^|[\s(\[])«", OPEN)
    s = r(s, r"[“«»\"]", CLOSE)
    ends = MARKS + ".…"
    s = r(s, rf"[{ends}](?=[^{OPEN}{CLOSE}]{{0,{QUOTE_MAX}}}{CLOSE})", INNER)
    # behind a quotation that ends with a mark: a unit ends unless the reporting clause follows
    s = r(s, rf"({INNER} ?{CLOSE}+[)\]]*)(?={GLUE} *{GLUE}(?:[{OPEN}(\[\p{{N}}]|\p{{Lu}}(?!{GLUE}\p{{Lu}})))", rf"$1{CUT}")
    df = df.withColumn(out, s)
    # in Greek the semicolon asks
    df = df.withColumn(out, F.when(raw.rlike(r"[α-ωά-ώ]"), r(t, rf"(?<=\p{{L}}{GLUE});", "?")).otherwise(t))
    # behind end marks, with the closing quotes and brackets that follow; a dot before a word is no end
    s = r(t, "\u037e", "?")
    tail = rf"(?:(?!(?<!\S)\.[\p{{L}}\p{{N}}])[{ends}](?:{GLUE}[{ends}])*(?: ?{CLOSE})?[)\]}}{CLOSE}]*)"
    s = r(s, rf"({tail})(?![,;:،、{ends}])(?!{GLUE}[^\p{{L}}\p{{N}}\n]{{0,20}}$)", rf"$1{CUT}")
    s = r(s, r"\n", rf"\n{CUT}".replace("\\n", "\n"))
    df = df.withColumn(out, s)
    thai = r"฀-๿"
    return df.withColumn(out, F.when(raw.rlike(f"[{thai}]"), r(t, rf"(?<=[{thai}]{GLUE}) +|(?<! ) +(?={GLUE}[{thai}])", rf"$0{CUT}")).otherwise(t))


def _block_spans(b: Column) -> Column:
    """struct<at: length of the block, out: spans from the block's start> of one block of units."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("out"))

    def add(acc: Column, u: Column) -> Column:
        start = acc["at"] + u["lead"]
        return F.struct((acc["at"] + u["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + u["body"]).alias("end")))).alias("out"))

    return F.aggregate(b, zero, add)


def sentence_units(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per unit: the kept columns, unit_no from 1, start_pos, end_pos (code points from 0, end exclusive), unit.

    Null, empty and blank texts have no unit. Repeated rows give their units again. Texts of any length are read whole.
    """
    blank = "[\\s\u200b-\u200f\u2060\ufeff\u00ad]"
    d = df.select(*keep, F.col(text).alias("_text"))
    d = _stages(d, "_text", "_marked").withColumn("_units", F.split("_marked", CUT))
    sized = F.transform(
        "_units",
        lambda u: F.struct(
            F.length(u).alias("n"),
            (F.length(u) - F.length(F.regexp_replace(u, rf"^{blank}+", ""))).alias("lead"),
            F.length(F.regexp_replace(u, rf"^{blank}+|{blank}+$", "")).alias("body"),
        ),
    )
    d = d.select(*keep, "_text", sized.alias("_sized"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_sized") - 1) / BLOCK).cast("int")), lambda i: F.slice("_sized", i * BLOCK + 1, F.lit(BLOCK)))
    d = d.select(*keep, "_text", F.transform(blocks, _block_spans).alias("_blocks"))
    starts = F.aggregate("_blocks", F.expr("cast(array(0) as array<int>)"), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
    d = d.withColumn("_starts", starts)
    moved = F.zip_with("_blocks", F.slice("_starts", 1, F.size("_blocks")), lambda b, s: F.transform(b["out"], lambda x: F.struct((x["start"] + s).alias("start"), (x["end"] + s).alias("end"))))
    d = d.select(*keep, "_text", F.filter(F.flatten(moved), lambda x: x["end"] > x["start"]).alias("_spans"))
    d = d.select(*keep, "_text", F.posexplode_outer("_spans").alias("_n", "_s")).where("_s is not null")  # outer: else a filter on the size computes all twice
    start, end = F.col("_s.start"), F.col("_s.end")
    return d.select(*keep, (F.col("_n") + 1).alias("unit_no"), start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"), F.substring("_text", start + 1, end - start).alias("unit"))
