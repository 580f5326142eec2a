from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiframe.functions import align, stats, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("word", ["O‘zim", "o’zim", "oʻzim", "oʼzim", "o`zim", "o´zim"])
def test_norm_apostrophes(spark, word):
    assert one(spark, text.norm(F.lit(word)).alias("x"))["x"] == "o'zim"


def test_norm_and_words(spark):
    r = one(spark, text.norm(F.lit("Привет, МИР!")).alias("a"), text.words(F.lit(" ")).alias("b"), text.words(F.lit("Bir, ikki")).alias("c"), text.norm(F.lit(None).cast("string")).alias("d"), text.norm_word(F.lit("Yo’q!")).alias("e"))
    assert r["a"] == "привет мир" and r["b"] == [] and r["c"] == ["bir", "ikki"] and r["d"] is None and r["e"] == "yo'q"


@pytest.mark.parametrize("path,call,key", [("audio/15286_p1_s2.flac", 15286, 102), ("15286.wav", 15286, 100), ("x.wav", None, 100), ("a/7_s3.wav", 7, 103)])
def test_path_keys(spark, path, call, key):
    r = one(spark, text.call_id_of(F.lit(path)).alias("c"), text.order_key(F.lit(path)).alias("k"))
    assert r["c"] == call and r["k"] == key


def test_sentence_ends_and_index(spark):
    t = "Ha. Yo'q! Bir 2.5 ikki… tamom"
    r = one(spark, text.sentence_ends(F.lit(t)).alias("e"), text.sentences(F.lit("Ha. Yo'q, men bor. ... Tamom")).alias("s"))
    assert r["e"] == [4, 10, 24]
    assert [(x["sentence"], x["first_word"], x["last_word"]) for x in r["s"]] == [("Ha.", 0, 0), ("Yo'q, men bor.", 1, 3), ("Tamom", 4, 4)]


def test_clean_repeats(spark):
    r = one(spark, text.clean_repeats(F.lit("Ha. ha. HA. Yo'q.")).alias("a"), text.clean_repeats(F.lit("Subscribe now!")).alias("b"), text.clean_repeats(F.lit("Ha. Obuna bo'ling kanalga! ha.")).alias("c"))
    assert r["a"] == "Ha. Yo'q." and r["b"] == "" and r["c"] == "Ha."


def test_spelling_and_repeats(spark):
    r = one(spark, text.spell(F.lit("hmm")).alias("a"), text.spell(F.lit("o'ttiz")).alias("b"), text.spell(F.lit("10")).alias("c"), text.longest_repeat(F.array(*map(F.lit, "abbbba"))).alias("d"), text.repeated_trigrams(F.array(*map(F.lit, "abcabc"))).alias("e"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("ha", "o'tiz", "o'n", 4, 1)


@pytest.mark.parametrize(
    "data,kind",
    [(b"RIFF0000WAVEfmt ", "audio/wav"), (b"fLaC" + b"0" * 9, "audio/flac"), (b"OggS" + b"0" * 9, "audio/ogg"), (b"0000ftypM4A 0", "audio/mp4"), (b"ID3" + b"0" * 10, "audio/mpeg"), (b"\xff\xfb" + b"0" * 11, "audio/mpeg"), (b"\xff\xf1" + b"0" * 11, "audio/aac"), (b"short", "application/octet-stream"), (b"nothing known", "application/octet-stream")],
)
def test_content_type(spark, data, kind):
    assert one(spark, text.content_type(F.lit(bytearray(data))).alias("x"))["x"] == kind


@pytest.mark.parametrize("header,want", [("bytes=0-9", (206, 0, 9)), ("bytes=90-", (206, 90, 99)), ("bytes=-5", (206, 95, 99)), ("bytes=50-500", (206, 50, 99)), ("bytes=100-", (416, None, None)), ("x", (200, 0, 99)), (None, (200, 0, 99))])
def test_byte_range(spark, header, want):
    r = one(spark, text.byte_range(F.lit(header).cast("string"), F.lit(100)).alias("x"))["x"]
    assert tuple(r) == want


def test_small_text_helpers(spark):
    r = one(spark, text.source_key(F.lit("  ")).alias("a"), text.valid_job_id(F.lit("abc-12345")).alias("b"), text.valid_job_id(F.lit("../x")).alias("c"), text.first_text([F.lit(None).cast("string"), F.lit(" "), F.lit(" x ")]).alias("d"), text.cps(F.lit("abcd"), F.lit(0.0)).alias("e"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("(none)", True, False, "x", 0.0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_alignment_properties(ref, hyp):
    s, d, i, ops = align.align_pair(ref, hyp)
    assert s + d + i == distance(ref, hyp)
    assert d - i == len(ref) - len(hyp)
    assert [o[1] for o in ops if o[1] is not None] == ref and [o[2] for o in ops if o[2] is not None] == hyp


def test_alignment_ties():
    assert align.align_pair(["a", "b"], ["b"])[:3] == (0, 1, 0)
    assert align.align_pair(["a"], ["b"])[:3] == (1, 0, 0)
    assert align.align_pair([], ["a", "b"])[:3] == (0, 0, 2)


def test_word_distance_equals_fold(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 15))], [rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 15))]) for _ in range(60)]
    d = spark.createDataFrame(rows, "r array<string>, h array<string>")
    got = d.select("r", "h", align.word_distance(F.col("r"), F.col("h")).alias("d"), align.align_ops(F.col("r"), F.col("h")).alias("a")).collect()
    for x in got:
        assert x["d"] == distance(x["r"], x["h"]) == x["a"]["subs"] + x["a"]["dels"] + x["a"]["ins"]


def test_blocks_and_maps(spark):
    r = one(spark, align.matching_blocks(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "bcde"))).alias("b"))
    assert [tuple(x) for x in r["b"]] == [(1, 0, 3)]
    assert align.map_index([(2, 5), (10, 13)], 4) == 7 and align.map_index([(2, 5)], 9) is None and align.map_index([], 1) is None
    assert align.anchor_times(["a", "x", "b"], ["a", "b"], [(0, 1), (1, 2)]) == {0: (0, 1), 2: (1, 2)}
    assert align.best_word_window(list("bcd"), list("abcdef"), 0)[1:] == (1, 4)


def test_order_statistics(spark):
    a = F.array(*[F.lit(float(x)) for x in range(10)])
    r = one(spark, stats.upper_median(a).alias("u"), stats.at_share(a, 0.95).alias("s"), stats.decile(a, 9).alias("d"), stats.bootstrap_bound(a, 0.25).alias("b"), stats.upper_median(F.array().cast("array<double>")).alias("n"))
    assert (r["u"], r["s"], r["d"], r["b"], r["n"]) == (5.0, 9.0, 9.0, 2.0, None)
