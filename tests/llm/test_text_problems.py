from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiframe.llm import encodings, forms, leaks, overlap, sentences, turns
from lexiframe.llm.edits import best_window, myers_distance

SENTENCES = [
    ("Salom dunyo. Men A. B. Qorvon bilan prof. Tolmasov keldim va h.k. Rangga hali.", ["Salom dunyo.", "Men A. B. Qorvon bilan prof. Tolmasov keldim va h.k.", "Rangga hali."]),
    ("Bugun 12 kv. uyda 53.7 so'm... davom etdi... Yana", ["Bugun 12 kv. uyda 53.7 so'm... davom etdi...", "Yana"]),
    ("“Telefon? bor ekan.” dedi ona. Keyin ketdi! «Juda.» Yangi gap", ["“Telefon? bor ekan.” dedi ona.", "Keyin ketdi!", "«Juda.»", "Yangi gap"]),
    ('"Savolimiz u!" dedi do`st. "Yana bor." Bola', ['"Savolimiz u!" dedi do`st.', '"Yana bor."', "Bola"]),
    ("お金。「支払い靴。」と言った答え。今.皿これ？", ["お金。", "「支払い靴。」と言った答え。", "今.", "皿これ？"]),
    ("เห็นบัตร คุณโทรศัพท์", ["เห็นบัตร", "คุณโทรศัพท์"]),
    ("Sayt info@ombor.example va sayt.test/yo v3.6 old.Yangi gap?Ha", ["Sayt info@ombor.example va sayt.test/yo v3.6 old.", "Yangi gap?", "Ha"]),
    ("Πόλη έφυγε; Γείτονας κ. Τολμάς είδε; Δώρο", ["Πόλη έφυγε;", "Γείτονας κ. Τολμάς είδε;", "Δώρο"]),
    ("„Später. Komm!“ sagte er am 3. Mai z. B. heute. Gut", ["„Später. Komm!“ sagte er am 3. Mai z. B. heute.", "Gut"]),
    ("(Rang keldi.) Yana (bor.) Ok", ["(Rang keldi.)", "Yana (bor.)", "Ok"]),
    ("a\nb. c", ["a", "b.", "c"]),
    ("Թուփ։ նվեր… հյուր։ ա", ["Թուփ։", "նվեր… հյուր։", "ա"]),
    ("ថ្ងៃ៕ ឃ្លាំង។", ["ថ្ងៃ៕", "ឃ្លាំង។"]),
    ("", []),
    ("   ", []),
    ("...", ["..."]),
    ("See https://a.uz/x?y=1 for more. Or www.Example.Com/Index.Html too.", ["See https://a.uz/x?y=1 for more.", "Or www.Example.Com/Index.Html too."]),
    ("Visit http://b.org/a!b. Then Node.JS runs. Gen. Smith and Sgt. Jones came. Ok", ["Visit http://b.org/a!b.", "Then Node.JS runs.", "Gen. Smith and Sgt. Jones came.", "Ok"]),
    ("Ha!! Yo'q?! Bor.", ["Ha!!", "Yo'q?!", "Bor."]),
]


def units(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("unit", F.lit("clash"))
    out: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in sentences.sentence_units(d, "t", ["i"]).orderBy("i", "unit_no").collect():
        assert texts[r["i"]][r["start_pos"] : r["end_pos"]] == r["unit"]
        out[r["i"]].append(r["unit"])
    return out


def test_sentence_units(spark):
    texts = [t for t, _ in SENTENCES] + [None, "Gap shu yerda. " * 20_000]
    got = units(spark, texts)
    for i, (_, want) in enumerate(SENTENCES):
        assert got[i] == want
    assert got[len(SENTENCES)] == [] and len(got[len(SENTENCES) + 1]) == 20_000


def test_units_cover_all_words(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .!?…\"«»()\n1,") for _ in range(rng.randint(0, 80))) for _ in range(80)]
    got = units(spark, texts)
    for i, t in enumerate(texts):
        assert "".join("".join(got[i]).split()) == "".join(t.split())
    assert sentences.sentence_units(spark.createDataFrame([], "t string"), "t", []).count() == 0


SAME = [("Ｓａｌｏｍ", "Salom"), ("café", "café"), ("so​z", "soz"), ("a b", "a b"), ("о‘zim", "o'zim"), ("ｶﾞｽ", "ガス"), ("⼦", "子"), ("ệ", "ệ"), ("ﬁ", "fi"), ("3‑7", "3-7"), ("ё", "ё")]
DIFFERENT = [("Salom", "salom"), ("e", "é"), ("a.", "a"), ("x²", "x2"), ("soz", "so'z")]


def test_canonical_forms(spark):
    rows = [(2 * i + k, p[k]) for i, p in enumerate(SAME + DIFFERENT) for k in (0, 1)] + [(900, None), (901, ""), (902, "")]
    d = spark.createDataFrame(rows, "row_id int, s string").withColumn("text", F.lit(1)).withColumn("form", F.lit(2)).drop("form")
    pairs = {(r[0], r[1]) for r in forms.same_looking_pairs(d, "row_id", "s").collect()}
    assert {(2 * i, 2 * i + 1) for i in range(len(SAME))} <= pairs
    assert not {(2 * i, 2 * i + 1) for i in range(len(SAME), len(SAME) + len(DIFFERENT))} & pairs
    f = {r["row_id"]: r["form"] for r in forms.with_form(d, "s").collect()}
    assert f[900] is None and f[901] == "" and len(f) == len(rows)
    assert all(unicodedata.is_normalized("NFC", x) for i, x in f.items() if x and i < 2 * len(SAME))
    assert forms.same_looking_pairs(d.where("row_id < 0"), "row_id", "s").count() == 0


def test_forms_equal_brute_force(spark):
    rng = random.Random(5)
    chars = "aéе̣́̈ｎﾊﾟ²'’‍ 한ế🙂"
    texts = sorted({"".join(rng.choice(chars) for _ in range(rng.randint(1, 12))) for _ in range(150)})

    def brute(s):
        flat = "".join(forms._one(ord(c)) for c in s)
        out, marks = [], []
        for ch in flat:
            if unicodedata.combining(ch):
                marks.append(ch)
            else:
                out += sorted(marks, key=unicodedata.combining) + [ch]
                marks = []
        return unicodedata.normalize("NFC", "".join(out + sorted(marks, key=unicodedata.combining)))

    got = {r["text"]: r["form"] for r in forms.canonical_texts(spark.createDataFrame([(t,) for t in texts], "s string"), "s").collect()}
    norm = {t: unicodedata.normalize("NFC", unicodedata.normalize("NFD", x)) for t, x in got.items()}
    assert norm == {t: unicodedata.normalize("NFC", unicodedata.normalize("NFD", brute(t))) for t in texts}
    assert len({got[t] for t in texts}) == len({brute(t) for t in texts})


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 12))
def test_myers(a, b, limit):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert myers_distance(a, b) == row[-1]
    assert myers_distance(a, b, limit) == min(row[-1], limit + 1)
    if a:
        best = min(myers_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert best_window(a, b)[0] == best


def test_overlap_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = ["kitob", "oyna", "savol", "telefon", "manzil", "daftar", "qutilar", "rang", "uylar", "bozor", "chiroq", "tovar"]
    base = [" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(40)]

    def edit(t):
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(["yangi", "eski"])
        return " ".join(w)

    dev = [edit(t) if i % 2 else t.upper() for i, t in enumerate(base)] + [None, "", "qisqa"]
    train = base + [None, "qisqa", base[0].replace("a", "а")]
    a = spark.createDataFrame(list(enumerate(train)), "row_id int, sentence string").withColumn("text", F.lit(0))
    b = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(dev)], "row_id int, sentence string").withColumn("g", F.lit(0))
    got = {(r[0], r[1]) for r in overlap.cross_split_pairs(a, b, "row_id", "sentence").select("train_row_id", "dev_row_id").collect()}

    def fold(t):
        return "".join(c for c in "".join(forms._one(ord(c)) for c in t or "").lower() if c.isalnum())

    want = set()
    for i, s in enumerate(train):
        for j, t in enumerate(dev):
            x, y = fold(s), fold(t)
            if len(x) >= 30 and len(y) >= 30 and myers_distance(x, y) <= int(max(len(x), len(y)) * 0.15 + 1e-9):
                want.add((i, 1000 + j))
    assert got == want and len(want) >= 41
    assert overlap.cross_split_pairs(a.where("row_id < 0"), b, "row_id", "sentence").count() == 0


def test_overlap_finds_scattered_edits_up_to_the_limit(spark):
    rng = random.Random(11)
    dev, train = [], []
    for i in range(120):
        n = rng.choice([30, 31, 34, 40, 60, 130, 300])
        t = [rng.choice("abdeghiklmnoqrstuvyz") for _ in range(n)]
        dev.append((1000 + i, "".join(t)))
        for at in rng.sample(range(n), int(n * 0.15)):
            t[at] = rng.choice(["", "x", "x", "x" + t[at]]) if i % 2 else "x"
        train.append((i, "".join(t)))
    want = {(i, 1000 + i) for (i, s), (_, t) in zip(train, dev, strict=True) if len(s) >= 30 and myers_distance(s, t) <= int(max(len(s), len(t)) * 0.15 + 1e-9)}
    a, b = spark.createDataFrame(train, "row_id int, sentence string"), spark.createDataFrame(dev, "row_id int, sentence string")
    got = {(r[0], r[1]) for r in overlap.cross_split_pairs(a, b, "row_id", "sentence").select("train_row_id", "dev_row_id").collect()}
    assert got == want and len(want) > 90


KNOWN = {"sotuvchi": "sotuvchi", "operator": "sotuvchi", "mijoz": "mijoz", "client": "mijoz", "?": "nomalum", "unknown": "nomalum"}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.05, 0.15, 0.3]), st.sampled_from(["ab", "abcdef", "abcdefghijklmnop"]))
def test_cosine_join_loses_no_pair(seed, share, letters):
    """Texts of 8 to 120 letters with scattered edits, any weights: the pairs within the limit are those of the plain edit distance."""
    rng = random.Random(seed)
    left = ["".join(rng.choices(letters, k=rng.randint(8, 120))) for _ in range(25)]
    right = []
    for t in left:
        x = list(t)
        for _ in range(int(rng.uniform(0, share * 1.1) * len(t))):
            at, kind = rng.randrange(len(x)), rng.choice("sid")
            x[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(letters)]
            x = x or ["a"]
        right.append("".join(x))
    weights = np.random.default_rng(seed).uniform(0.1, 9, overlap.CELLS)
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            k = int(max(len(a), len(b)) * share + 1e-9)
            e = myers_distance(a, b, k)
            if e <= k:
                want[i, j] = e
    assert {(i, j): e for i, j, e in overlap.close_pairs(left, right, share, weights)} == want


def test_overlap_rows_count_links(spark):
    """One row per linked row: copies share a class, links are counted and not expanded."""
    t = "bu gap yetarli darajada uzun bo'lgan bitta gapdir"
    a = spark.createDataFrame([(1, t, "x"), (2, t, "y"), (3, t.upper() + "!", "z"), (4, "butunlay boshqa narsa haqida uzun gap edi", "x"), (5, None, "x")], "row_id long, sentence string, k1 string").drop("k1")
    b = spark.createDataFrame([(10, t.replace("uzun", "uzum")), (11, t)], "row_id long, sentence string")
    got = {(r["split"], r["row_id"]): (r["class_id"], r["n_texts"], r["n_links"]) for r in overlap.cross_split_rows(a, b, ["row_id"], "sentence").collect()}
    assert got.keys() == {("train", 1), ("train", 2), ("train", 3), ("dev", 10), ("dev", 11)}
    assert got["train", 1][0] == got["train", 3][0] == got["dev", 11][0] != got["dev", 10][0]
    assert got["train", 1][1:] == (2, 2) and got["dev", 10][1:] == (1, 3)


@pytest.mark.parametrize(
    "segments,full,want",
    [
        ('[{"role": "Sotuvchi:", "text": "[00:01] Salom hm, bor"}, {"role": "sotuvchi 1", "text": "[kulgi]"}, {"role": null, "text": "Yana"}, {"role": "<mijoz>", "text": "soat 10:30 da"}]', None, [("sotuvchi", 3), ("mijoz", 3)]),
        ('[{"speaker": "client", "start": 5, "text": "ikki"}, {"speaker": "opertor", "start": 1, "text": "bir"}]', None, [("sotuvchi", 1), ("mijoz", 1)]),
        (None, "00:01 [mijoz] Ha bor\nsotuvchi:\nYo'q e-e\n(0:09) cliennt - Mayli ♪", [("mijoz", 2), ("sotuvchi", 1), ("mijoz", 1)]),
        ("[]", "oddiy gap", [("nomalum", 2)]),
        ("broken", None, []),
        ('[{"text": "?"}, {"role": "Karim", "text": "gap"}, "x", {"role": "mijoz"}]', None, [("nomalum:karim", 1)]),
    ],
)
def test_turns(segments, full, want):
    assert [(s, len(w)) for s, w in turns.transcript_turns(segments, full, KNOWN)] == want


def test_turn_table(spark):
    t = spark.createDataFrame([("k", '[{"role": "mijoz", "text": "bir ikki"}]', "x"), ("k", '[{"role": "mijoz", "text": "bir ikki"}]', "x"), (None, None, "gap"), ("e", None, None)], "call_key string, segments_json string, full_text string").withColumn("speaker", F.lit(1))
    labels = spark.createDataFrame(list(KNOWN.items()), "label string, speaker string")
    assert [tuple(r) for r in turns.speaker_turns(t, labels).collect()] == [("k", 1, "mijoz", 2, "bir ikki")]
    assert turns.speaker_turns(t.where("1 = 0"), labels).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"so'z{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(25))) for i in range(12)]
    docs = []
    for d in range(120):
        _, p = items[d % 12]
        w, n, at = p.split(), rng.choice([6, 9, 10, 11, 20]), rng.randrange(6)
        part = [x.upper() if rng.random() < 0.3 else x.replace("'", "’") for x in w[at : at + n]]
        docs.append((d, "+// " + " ".join(rng.choice(vocab) for _ in range(5)) + "\n# " + ",\n+ ".join(part)))
    docs += [(500, None), (501, "")]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit(0)).withColumn("words", F.lit(0))
    h = spark.createDataFrame([*items, (99, None), (98, "")], "item_id int, passage string")
    got = {(r[0], r[1]) for r in leaks.leaked_passages(d, "doc_id", "text", h, "item_id", "passage").where("words >= 10").select("item_id", "doc_id").collect()}
    want = set()
    for i, p in items:
        w = leaks.words_of(p)
        grams = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        for k, t in docs:
            x = leaks.words_of(t or "")
            if any(tuple(x[j : j + 10]) in grams for j in range(len(x) - 9)):
                want.add((i, k))
    assert got == want and len(want) > 30


def test_leak_across_a_number_in_ascii(spark):
    passage = "bir ikki narx 10.47 som va foo`bar yana 1,234.5 keldi"
    rows = [(1, "# " + passage), (2, "é " + passage), (3, passage.replace("`", "'")), (4, passage.replace("10.47", "10.4 7"))]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    h = spark.createDataFrame([(9, passage)], "item_id int, passage string")
    got = {r["doc_id"]: (r["words"], r["edits"]) for r in leaks.leaked_passages(d, "doc_id", "text", h, "item_id", "passage").collect()}
    assert {k: got[k] for k in (1, 2, 3)} == dict.fromkeys((1, 2, 3), (10, 0)) and got.get(4, (0, 0))[0] < 10


@pytest.mark.parametrize("text,chain", [("Köşe için «ğüş»", "utf-8>cp1252"), ("Плохо большой телефоны", "koi8-r>cp1251"), ("Плохо большой", "cp866>cp1251"), ("déjà reçu à", "cp1252>cp437"), ("城市盘子五，鞋子？", "gbk>cp1252"), ("Vélo où", "utf-8>cp1252>utf-8>cp1252")])
def test_encoding_chains_round_trip(text, chain):
    steps = chain.split(">")
    bad = text
    for right, wrong in zip(steps[::2], steps[1::2], strict=True):
        inv = {b: c for c, b in encodings.high_chars(wrong).items()}
        bad = "".join(chr(b) if b < 0x80 else inv[b] for b in bad.encode(right))
    assert bad != text and encodings.repaired(bad, chain) == text


def test_garbled_documents(spark):
    rng = random.Random(2)
    ru = "платёж большой телефон магазин районов быстро ответов сегодня вопрос зелёный подарок потом".split()
    fr = "déjà reçu où être hôtel cuillère très prêt numéro".split()
    docs = [(i, "\n".join("    " + " ".join(rng.choice(ru if i % 2 else fr) for _ in range(9)) for _ in range(4)), f"s{i % 3}") for i in range(200)]

    def bad(t, right, wrong):
        inv = {b: c for c, b in encodings.high_chars(wrong).items()}
        return "".join(chr(b) if b < 0x80 else inv[b] for b in t.encode(right))

    truth = {}
    for i in (3, 21, 43):
        truth[i], docs[i] = docs[i][1], (i, bad(docs[i][1], "koi8-r", "cp1251"), docs[i][2])
    for i in (4, 22, 44):
        truth[i], docs[i] = docs[i][1], (i, bad(docs[i][1], "utf-8", "cp1252"), docs[i][2])
    docs += [(300, None, "s0"), (301, "", None), (302, "    m�me", "s1"), (303, "plain ascii", "s1")]
    d = spark.createDataFrame(docs, "doc_id int, text string, source string").withColumn("line", F.lit(0)).withColumn("n", F.lit(0))
    assert {r[0] for r in encodings.garbled_documents(d).collect()} == {*truth, 302}
    got = {r["doc_id"]: r["text"] for r in encodings.repaired_documents(d).collect()}
    assert {i: got[i] for i in truth} == truth and got[302] == "    m�me"
    assert encodings.garbled_documents(d.where("doc_id < 0")).count() == 0


def test_chains_that_lose_by_single_characters_are_scored(spark):
    rng = random.Random(4)
    ru = "платёж большой телефон магазин районов быстро ответов сегодня вопрос зелёный подарок потом".split()
    fr = "déjà élève payé être hôtel répété très prêt numéro".split()
    inv = {b: c for c, b in encodings.high_chars("cp1251").items()}
    clean = [" ".join(rng.choice(ru if i % 20 else fr) for _ in range(9)) for i in range(200)]
    bad = "".join(chr(b) if b < 0x80 else inv[b] for b in "élève déjà payé répété numéro prêt".encode("cp1252"))
    rows = [(i, 0, "s", "diff", x) for i, x in enumerate([*clean, bad])]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, source string, field string, line string")
    model = encodings.train_model(lines.where("doc_id < 200"))
    alts = {encodings.chain_names()[a["chain"]]: a["gain"] for a in encodings.score_lines(lines, model).where("doc_id = 200").first()["alts"]}
    want = dict(zip(["was", "is"], model.score(["", bad, encodings.repaired(bad, "cp1252>cp1251")])[1:], strict=True))
    assert alts["cp1252>cp1251"] == pytest.approx(want["is"] - want["was"], abs=0.01) and max(alts, key=alts.get) == "cp1252>cp1251"


def test_forms_unify_composition(spark):
    """Hangul, Hindi, Vietnamese and long clusters: every canonical spelling gives the form that Unicode's composition gives."""
    texts = ["한국어 문장입니다", "각 값", "हिन्दी में क़लम", "Tiếng Việt rất khó", "a\u0323\u0302\u0301\u0308 x", "e\u0301\u0323\u0302\u030c", "q\u0307\u0323\u0301", "ᄀ ᅡ"]
    rows = [(i, v) for i, t in enumerate(texts) for v in {t, unicodedata.normalize("NFD", t), unicodedata.normalize("NFC", t)}]
    rows.append((1, "가\u11a8 값"))  # a syllable with its final jamo apart
    d = spark.createDataFrame(rows, "i int, t string")
    got: dict[int, set] = {}
    for r in forms.with_form(d, "t").collect():
        got.setdefault(r["i"], set()).add(r["form"])
    assert got == {i: {unicodedata.normalize("NFC", t)} for i, t in enumerate(texts)}


def test_same_looking_rows(spark):
    d = spark.createDataFrame([(1, "salom"), (2, "s\u0430lom"), (3, "salom"), (4, "boshqa"), (5, None)], "row_id long, sentence string")
    got = {r["row_id"]: (r["class_id"], r["n_variants"]) for r in forms.same_looking_rows(d, "row_id", "sentence").collect()}
    assert got.keys() == {1, 2, 3} and len(set(got.values())) == 1 and got[1][1] == 2


def test_words_keep_their_marks():
    assert leaks.words_of("हिन्दी में लिखा, है") == ["हिन्दी", "में", "लिखा", "है"]
    for t in ("noël йод Việt", "बांग्ला ভাষা"):
        assert leaks.words_of(unicodedata.normalize("NFD", t)) == leaks.words_of(unicodedata.normalize("NFC", t))
    assert leaks.words_of("O\u2018zbek so\u00adz 10,5 за\u0301мок") == ["ozbek", "soz", "105", "замок"]


def test_leaks_report_edits_of_each_hit(spark):
    """Every hit is measured: an exact run has no edits, a changed letter one, two are out of the budget."""
    item = "bir ikki uch tort besh olti yetti sakkiz toqqiz on"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, item.replace("yetti", "yetta")), (3, item.replace("yetti", "yatta"))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, passage string")
    got = {r["doc_id"]: (r["words"], r["edits"]) for r in leaks.leaked_passages(docs, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == {1: (10, 0), 2: (6, 1)}


def test_unknown_speakers_stay_apart():
    segs = '[{"speaker": "Alice", "text": "salom"}, {"speaker": "Bob", "text": "ha"}, {"speaker": "Alicee", "text": "yaxshi"}, {"speaker": "??", "text": "kim"}]'
    got = turns.transcript_turns(segs, None, {"sotuvchi": "sotuvchi"})
    assert [w for _, w in got] == [["salom"], ["ha"], ["yaxshi"], ["kim"]]
    assert got[0][0] == got[2][0] != got[1][0] and all(s.startswith(turns.UNKNOWN) for s, _ in got) and got[3][0] == turns.UNKNOWN
