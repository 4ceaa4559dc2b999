import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nyuzi.functions import text as X

TEXTS = st.lists(st.text(alphabet="ab ĩũÅÄ⁇.!? [cs]'—x", max_size=24), min_size=1, max_size=20)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_goldens(spark):
    assert one(spark, "AndÅ© magÄ©thondeka tÅ©thandÅ©kÅ©", X.fix_double_encoding) == "Andũ magĩthondeka tũthandũkũ"
    assert one(spark, "Ä¨", X.fix_double_encoding) == "Ĩ"
    assert one(spark, "donâ€™t", X.fix_double_encoding) == "don't"
    assert one(spark, "Å©", X.fix_double_encoding) == "Å©"
    assert one(spark, "Å⁇ a. Ä ⁇b Å⁇", X.clean_prediction) == "Ũa. Ĩb ũ"
    assert one(spark, "Ä⁇", lambda c: X.clean_prediction(c, "as_written")) == "Ä??"
    assert one(spark, "Hello, [cs]  World—ok!", X.normalize) == "hello cs world ok"
    assert one(spark, "a [cs] b [pause]", X.strip_tags) == "a b"
    assert one(spark, None, X.normalize) == ""
    assert one(spark, None, X.clean_prediction) == ""
    assert one(spark, "", X.words) == []


def python_clean(text):
    """The rule letter by letter: a base letter, blanks and an unknown token, with the blanks after it, are one letter."""
    t = text.replace("â€™", "'")
    for base, capital, small in (("Å", "Ũ", "ũ"), ("Ä", "Ĩ", "ĩ")):
        done, i = [], 0
        while i < len(t):
            j = i + 1
            while j < len(t) and t[j].isspace():
                j += 1
            if t[i] == base and j < len(t) and t[j] == X.UNKNOWN:
                begins = i == 0 or t[:i].rstrip()[-1:] in (".", "!", "?")
                done.append(capital if begins else small)
                i = j + 1
                while i < len(t) and t[i].isspace():
                    i += 1
            else:
                done.append(t[i])
                i += 1
        t = "".join(done)
    return " ".join(unicodedata.normalize("NFKC", t.replace(X.UNKNOWN, "")).split())


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_clean_prediction_equals_the_rule(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean_prediction(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [python_clean(r["t"]) for r in rows]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(alphabet="ab ũ", max_size=20), st.text(alphabet="ab ũ", max_size=20)), min_size=1, max_size=20))
def test_edits(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", X.token_edits(X.words(F.col("a")), X.words(F.col("b"))).alias("w"), X.letter_edits(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        assert r["w"] == distance(r["a"].split(), r["b"].split())
        assert r["c"] == distance(r["a"], r["b"])


def test_edits_with_many_different_words(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1, 3001))
    assert spark.createDataFrame([(a, b)], "a string, b string").select(X.token_edits(X.words(F.col("a")), X.words(F.col("b")))).first()[0] == 2
