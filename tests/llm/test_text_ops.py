import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("kinweave.llm")
from pyspark.sql import functions as F  # noqa: E402

from kinweave.llm import garble, lookalike, mixing, split, tokens  # noqa: E402

# ---- garbled text


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "iso8859_2", "cp1251"])
def test_round_trip_of_wrong_tables(codec):
    good = "Le prieur âgé a présenté la clé brisée près du pont — à voix basse, über große Brücke."
    raw = good.encode("utf-8")
    bad = raw.decode(codec, "strict") if codec in ("latin-1", "mac_roman", "cp437", "cp850", "iso8859_2") else "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw)
    fixed, n = garble.decode_spans(bad)
    assert fixed == good and n > 0


def test_twice_garbled():
    good = "tête-à-tête"
    bad = good.encode().decode("cp1252").encode().decode("cp1252")
    assert garble.decode_spans(bad)[0] == good


@pytest.mark.parametrize("text", ["CHÂTEAU — ÂGE INCERTAIN — PÂQUES", "DOAÇÃO DA RAÍNHA, SÃO MARTINHO", "«\xa0été\xa0»", "грамота князя, лист 7", "В\xa0начале", "Ἐν ὀνόματι τοῦ κυρίου", "¶ § 12 † ‡ n° 4 — £ 3½", "þe kyng & þe queene, Æðel", "l’été “É”", "Âme damnée, Ça ira, Ñandú", "", "ascii"])
def test_correct_text_is_left(text):
    assert garble.decode_spans(text) == (text, 0)
    assert not any(garble.impossible(w) for w in garble.WORD.findall(text))


def test_repair_table(spark):
    rows = [(1, "un tÃ©moin jurÃ©", 0), (2, "un tÈmoin jurÈ", 0), (3, "l'abb� du lieu", 0), (4, None, 0), (5, "", 0), (6, "plain " * 5000, 0), (7, "Élan déjà vu", 0), (1, "un tÃ©moin jurÃ©", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored int")
    out = {r["doc_id"]: r for r in garble.repair(df).collect()}
    assert [out[i]["garbled"] for i in range(1, 8)] == [True, True, True, False, False, False, False]
    assert out[1]["restored"] == "un témoin juré" and out[2]["restored"] == "un témoin juré"
    assert not out[3]["restorable"] and out[4]["restored"] is None and out[6]["restored"] == "plain " * 5000
    assert garble.repair(df.limit(0)).count() == 0


# ---- look-alikes


@pytest.mark.parametrize("bad,good", [("Gіѕеlа of Nubrofаvоw", "Gisela of Nubrofavow"), ("a b c", "a b c"), ("﻿no​n­", "non"), ("été", "été"), ("Ｇｒｏ ﬁn Ⅲ", "Gro fin III"), ("vοn", "von"), ("que dе ас te", "que de ac te")])
def test_consistent_form(bad, good):
    assert lookalike.consistent(bad) == good


@pytest.mark.parametrize("text", ["æ ę Œuvre déjà", "In dorso: князь и город.", "Grece: ἐν ἀρχῇ.", "a\nb", "λόγος καὶ πίστις"])
def test_ordinary_text_is_consistent(text):
    assert lookalike.consistent(text) == text


def test_unify_by_classes(spark):
    rows = [("n", "1", "vοn Lobä"), ("n", "2", "von Lobä"), ("n", "3", "von Lobä"), ("n", "4", None), ("n", "5", ""), ("t", "1", "x" * 9000 + "​ y"), ("t", "2", "грамота старая"), ("n", "1", "vοn Lobä")]
    df = spark.createDataFrame(rows, "field_name string, record_key string, value string")
    out = {(r["field_name"], r["record_key"]): r for r in lookalike.unify(df).collect()}
    assert {out["n", k]["unified"] for k in "123"} == {"von Lobä"}
    assert [out["n", k]["changed"] for k in "12345"] == [True, False, True, False, False]
    assert out["t", "1"]["unified"] == "x" * 9000 + " y" and not out["t", "2"]["changed"]
    assert {tuple(r) for r in lookalike.found_records(df).collect()} == {("n", "1"), ("n", "3"), ("t", "1")}
    assert lookalike.found_records(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abе о́ｆ​ é.ω", max_size=30))
def test_consistent_is_idempotent(t):
    once = lookalike.consistent(t)
    assert lookalike.consistent(once) == once


# ---- splitting


def brute_pieces(text, limit, overlap):
    s, n = split.strengths(text), len(text)
    if n <= limit:
        return [(0, n)]
    overlap, out, start = max(0, min(overlap, limit // 2 - 1)), [], 0
    while n - start > limit:
        end = max(range(start + max(limit // 2, overlap + 1), start + limit + 1), key=lambda i: (s[i], i))
        out.append((start, end))
        start = end - overlap
        while start > out[-1][0] + 1 and s[start] < 0:
            start -= 1
    return [*out, (start, n)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,;\n/é", max_size=400), st.integers(10, 60), st.integers(0, 40))
def test_pieces_match_brute_force(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    assert got == brute_pieces(text, limit, overlap)
    assert all(b - a <= limit for a, b in got) and got[0][0] == 0 and got[-1][1] == len(text)
    assert all(c <= b for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_split_table(spark):
    rows = [("1", "a" * 25), ("1", "a" * 25), ("2", None), ("3", ""), ("4", "one two three. four five six"), (None, "y" * 30)]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("piece", F.lit(1))
    out = split.split_oversized(df, "id", "t", 20, 5).orderBy("id", "piece_no").collect()
    assert [(r["id"], r["piece_no"], len(r["piece"])) for r in out if r["id"] == "1"] == [("1", 1, 20), ("1", 2, 10)]
    assert [r["piece"] for r in out if r["id"] == "4"][0].endswith(". ")
    assert {r["id"] for r in out} == {None, "1", "4"}
    assert split.split_oversized(df.limit(0), "id", "t", 20, 5).count() == 0


# ---- tokens


@pytest.fixture(scope="module")
def transducer():
    try:
        return tokens.Transducer(tokens.read_vocabulary())
    except OSError:
        pytest.skip("no vocabulary files")


@pytest.fixture(scope="module")
def reference(transducer):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=transducer.rank, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200) | st.text(alphabet="ab \n'st1é-", max_size=300))
def test_same_ids_as_plain_merging(transducer, reference, text):
    ids = transducer.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert transducer.decode(ids) == text


def test_streaming_long_words_and_blocks(transducer, reference):
    rng = random.Random(3)
    for alphabet in ("ab", "the", "é-", "01"):
        word = "".join(rng.choice(alphabet) for _ in range(4000))
        chunks = [word.encode()[i : i + 37] for i in range(0, len(word.encode()), 37)]
        want = [i for w in tokens.WORDS.findall(word) for i in reference.encode_ordinary(w)]
        assert transducer.encode(word) == want
        if alphabet in ("ab", "the"):
            assert list(transducer.stream(chunks)) == want
    text = " ".join("".join(rng.choice("abcde\n") for _ in range(rng.randrange(1, 12))) for _ in range(30_000))
    assert "".join(tokens.blocks(text)) == text and len(list(tokens.blocks(text))) > 1
    assert transducer.encode(text) == reference.encode_ordinary(text)


def test_token_table(spark, transducer):
    df = spark.createDataFrame([(1, "Le prieur âgé"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    rows = {r["doc_id"]: r for r in tokens.encode(df).collect()}
    assert rows[2]["ids"] == [] and rows[3]["ids"] == [] and 50256 not in rows[4]["ids"]
    back = {r["doc_id"]: r["back"] for r in tokens.decode(tokens.encode(df), into="back").collect()}
    assert back == {1: "Le prieur âgé", 2: "", 3: "", 4: "<|endoftext|>"}
    assert tokens.encode(df.limit(0)).count() == 0


# ---- mixing


def test_mixture_reaches_shares(spark, transducer):
    rng = random.Random(1)
    rows = [(i, "big" if i % 10 else "small", " ".join(["word"] * rng.randrange(5, 40))) for i in range(2000)] + [(9001, "none", "a"), (9002, None, "b"), (9003, "big", None), (9004, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit(0))
    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.35, 3), ("empty", 0.05, 2)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(docs, goal, cell_rows=200)
    r = {x["source"]: x for x in report.collect()}
    assert r["big"]["actual_share"] == pytest.approx(0.6 / 0.95, abs=0.01) and r["small"]["actual_share"] == pytest.approx(0.35 / 0.95, abs=0.01)
    assert not r["empty"]["reachable"] and r["none"]["actual_share"] == 0.0
    assert copies.count() == len(rows)
    assert copies.where("source = 'big' AND copies > 1 OR source = 'small' AND copies > 3").count() == 0
    _, short = mixing.mix(docs, goal, total_tokens=1e9)
    s = {x["source"]: x for x in short.collect()}
    assert not s["big"]["reachable"] and s["big"]["max_copies"] == 1 and s["small"]["max_copies"] == 3
    assert mixing.mix(docs.limit(0), goal)[0].count() == 0


# ---- further letters, layers and totals


def test_letters_of_more_scripts():
    assert [lookalike.consistent(t) for t in ("Ꮯarolus", "ꓐerta", "dꭵx", "cᴏmes", "ℓex", "𝐀bbas", "ɑbbas")] == ["Carolus", "Berta", "dix", "comes", "lex", "Abbas", "abbas"]
    assert lookalike.consistent("ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ") == "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ"  # words truly of that script


def test_garbled_many_times():
    text = "déjà prieuré"
    for _ in range(6):
        text = text.encode("utf-8").decode("latin-1")
    assert garble.decode_spans(text)[0] == "déjà prieuré"


def test_total_is_bounded_below(spark):
    docs = spark.createDataFrame([(i, "big" if i else "small", "word " * 50) for i in range(41)], "doc_id int, source string, text string")
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], "source string, target_share double, max_repeats int")
    used = lambda least: {r["source"]: (r["used_share"], r["reachable"]) for r in mixing.mix(docs, goal, least_used=least)[1].collect()}
    assert used(0.0)["big"][0] < 0.05 and used(0.0)["small"] == (1.0, True)
    assert used(0.5)["small"] == (1.0, False) and 0.2 < used(0.5)["big"][0] < 0.3
