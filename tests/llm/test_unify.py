import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nyuzi.llm import unify as U

CASES = {
    "Ｗａｃｅ cugĩ．": "Wace cugĩ.",
    "P𝐨𝐡𝐚𝐫": "Pohar",
    "raa‌naa ﻿b­a": "raanaa ba",
    "a b c　d": "a b c d",
    "Akĩ": "Akĩ",
    "ng’a ngʼb ngꞌc ng′d": "ng'a ng'b ng'c ng'd",
    "mер ρuρo tаɡi": "mep pupo tagi",
    "３０ °C": "30 °C",
    "ﬁle": "file",
    "ｱｶﾞ ㎏ ﷺ": "アガ kg صلى الله عليه وسلم",
    "ĳs Ǆ ŉa ⑴ ①⑩ ㏇ 1⁄2": "ijs DŽ 'na (1) 110 Co. 1/2",
    "१२ ٣": "12 3",
    "pսre Ꮓoo": "pure Zoo",
}
CLEAN = ["жолдарың λόγιψη", "“sawa” «dala» — – © € °", "Awɔ́rɔ́ ok", "two  blanks ", "", None, "Zoë fête", "a\nb", "½ ² ª … µ № ™", "ກຳ նաև", "ϑ ㄱ"]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    return [(r["clean_text"], r["changed"]) for r in sorted(U.unify(df, ["row_id"]).collect(), key=lambda r: r["row_id"])]


def test_cases(spark):
    assert run(spark, list(CASES)) == [(v, True) for v in CASES.values()]
    assert run(spark, CLEAN) == [(t, False) for t in CLEAN]


def test_long_and_repeated_texts(spark):
    long = "ａ b" * 200_000
    got = run(spark, [long, "x​", "x​", "plain" * 200_000])
    assert got == [("a b" * 200_000, True), ("x", True), ("x", True), ("plain" * 200_000, False)]


def test_every_form_settles():
    assert len(U.FORMS) > 3000 and all(unicodedata.normalize("NFC", U.FORMS.get(c, c)) == c for f in U.FORMS.values() for c in unicodedata.normalize("NFC", f) if c not in U.FORMS)


def test_null_keys(spark):
    df = spark.createDataFrame([(None, "ａ"), (None, None)], "row_id long, text string")
    assert sorted((r["clean_text"] or "", r["changed"]) for r in U.unify(df, ["row_id"]).collect()) == [("", False), ("a", True)]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab 'ũ̃́ａ．​ ера𝐚ɡʼ’“—жλ\n", max_size=30), min_size=1, max_size=30))
def test_one_pass_is_enough(spark, texts):
    once = [t for t, _ in run(spark, texts)]
    assert once == [unicodedata.normalize("NFC", t) for t in once]
    assert run(spark, once) == [(t, False) for t in once]
