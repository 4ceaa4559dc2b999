from hypothesis import given
from hypothesis import strategies as st

from nyuzi.llm import mojibake as M

WORDS = ["mũndũ", "kĩrĩa", "andũ", "olŋɔ́", "sɨnyɛ", "pâlé", "café", "“sawa”", "ng’a"]


def restored(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    found = {r["row_id"]: r["lost"] for r in M.find_garbled(df, ["row_id"]).collect()}
    fixed = {r["row_id"]: (r["restored"], r["fully"]) for r in M.restore(df, ["row_id"]).collect()}
    assert set(found) == set(fixed) and all(found[k] == (not fixed[k][1]) for k in found)
    return fixed


def test_every_chain_comes_back(spark):
    clean = " ".join(WORDS)
    texts = [clean, *(M.garble(clean, c) for c in M.CHAINS)]
    got = restored(spark, texts)
    assert 0 not in got
    for i, t in enumerate(texts[1:], 1):
        assert got[i] == (clean, True), (M.CHAINS[i - 1], t)


def test_words_that_stand_nowhere_clean(spark):
    got = restored(spark, ["seÃ±al x", "ZoÃ« y", "fĂŞte", "f├¬te", "Zo√´", "wĩra wa", M.garble("ũtũkũ", ("cp1252",))])
    assert {k: v[0] for k, v in got.items()} == {0: "señal x", 1: "Zoë y", 2: "fête", 3: "fête", 4: "Zoë", 6: "ũtũkũ"}


def test_letters_of_no_one_chain_are_reported_but_not_put_in(spark):
    mixed = M.garble("ũ", ("cp1252",)) + M.garble("ĩ", ("mac_roman",)) + "xyz"
    assert restored(spark, [mixed, M.garble("ũĩxyz", ("cp850",))]) == {0: (mixed, False), 1: ("ũĩxyz", True)}


def test_decoys_stay(spark):
    assert restored(spark, ["Ätosh Ãro Ålvor pâlé Ñuma", "© 2019 30 °C €40", "жолдарың λόγιψη", "«ála» — “x” …y", "", None, "plain", "Ålvor"]) == {}


def test_lost_letters(spark):
    got = restored(spark, ["MÅ� kĩ", "��nyiga MÅ©", "ok"])
    assert got == {0: ("MÅ� kĩ", False), 1: ("��nyiga Mũ", False)}
    marks = ["N?be m?ku ng?u.", "IL?OJI ?B", "In?ajir?? pan", "caf? M?n?"]
    assert restored(spark, marks) == {i: (t, False) for i, t in enumerate(marks)}
    assert restored(spark, ["Kiba? Made?", "what?And", "see https://a.b/c?d=e", "?", "“ku?” yo ??"]) == {}


def test_white_space_punctuation_and_repeats(spark):
    t = "  mÅ©ndÅ©,\t(kÄ©)\nx  mÅ©ndÅ©. "
    got = restored(spark, [t, t, "mũndũ"])
    assert got == {0: ("  mũndũ,\t(kĩ)\nx  mũndũ. ", True)} | {1: ("  mũndũ,\t(kĩ)\nx  mũndũ. ", True)}


def test_very_long_text(spark):
    long = "neno " * 100_000 + "mÅ©ndÅ©"
    assert restored(spark, [long])[0][0] == "neno " * 100_000 + "mũndũ"


@given(st.text(alphabet="abĩũŋɔé'", min_size=1, max_size=12))
def test_garbled_forms_are_all_chains(word):
    forms = M.garbled_forms(word)
    assert set(forms) == {M.garble(word, c) for c in M.CHAINS} - {word}
    if word.isascii():
        assert not forms
