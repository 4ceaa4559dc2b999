import random

import numpy as np

from nyuzi.llm import reading as R


def text_of(rng, level, layout):
    easy = ["cat", "dog", "sun", "red", "run", "sit", "hen", "cup", "big", "tree", "milk", "farm"]
    hard = ["jurisprudence", "diversification", "authorisation", "methodology", "interoperability", "acknowledgement"]
    length, share = [5, 8, 12, 18, 25][level - 1], [0.0, 0.05, 0.15, 0.3, 0.5][level - 1]
    sentences = [[rng.choice(hard) if rng.random() < share else rng.choice(easy) for _ in range(max(3, round(rng.gauss(length, 1))))] for _ in range(12)]
    s = [" ".join(x).capitalize() + "." for x in sentences]
    if layout == "list":
        return "\n".join(f"{i}) {x}" for i, x in enumerate(s, 1))
    if layout == "dialogue":
        return "\n".join(f"{'AB'[i % 2]}: {x}" for i, x in enumerate(s))
    if layout == "bare":
        return " ".join(" ".join(x) for x in sentences)
    return " ".join(s)


def made_up(n=700, seed=5):
    rng = random.Random(seed)
    docs, level, graded = [], {}, []
    for i in range(n):
        level[i] = rng.randint(1, 5)
        docs.append((i, text_of(rng, level[i], rng.choice(["prose", "list", "dialogue", "prose", "bare"])), rng.choice(["eng", "eng", None])))
        if i % 6 == 0:
            graded.append((i, level[i] + (rng.choice([-1, 1]) if rng.random() < 0.05 else 0)))
    return docs, level, graded


def test_held_out_accuracy(spark):
    docs, level, graded = made_up()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(graded, "doc_id long, level int")
    got = {r["doc_id"]: r["level"] for r in R.reading_levels(df, labels).collect()}
    held = [i for i in level if i % 6]
    right = np.mean([(got[i] >= 3.5) == (level[i] >= 4) for i in held])
    error = np.mean([abs(got[i] - level[i]) for i in held])
    assert right > 0.93 and error < 0.5, (right, error)


def test_odd_rows(spark):
    docs, level, graded = made_up(200)
    long = "Cat sat. " * 50_000
    odd = [(1000, None, "eng"), (1001, "", None), (1002, "12 %", "eng"), (1003, long, "eng"), (None, "Cat sat.", "eng"), (1004, "Cat sat.", "xxx"), (1004, "Cat sat.", "xxx"), (1005, docs[0][1], docs[0][2] or "eng"), (1006, docs[0][1], docs[0][2] or "eng")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, g) for i, g in graded] + [(7, None), (None, 3), (9, 2), (9, 4), (424242, 1)], "doc_id long, level int")
    rows = R.reading_levels(df, labels).collect()
    assert len(rows) == len(docs) + len(odd)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["level"])
    assert got[1000] == got[1001] == got[1002] == [None] and got[1003][0] is not None and len(got[1004]) == 2
    assert got[1005] == got[1006] and got[9] == [3.0] and all(got[i] == [g] for i, g in graded if i not in (7, 9))


def test_without_grades_nothing_is_known(spark):
    df = spark.createDataFrame([(1, "Cat sat on it.", "eng")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([(1, None)], "doc_id long, level int")
    assert [r["level"] for r in R.reading_levels(df, none).collect()] == [None]
    assert R.demanding(df, none).collect() == []


def test_rare_words_count_where_no_sentence_is_told(spark):
    rng = random.Random(1)
    common, rare = ["".join(rng.choice("bdgk") + rng.choice("aeiou") for _ in range(3)) for _ in range(8)], ["".join(rng.choice("mnpr") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(rare) if rng.random() < 0.1 * (i % 5) else rng.choice(common) for _ in range(60)), "swa") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 + i % 5) for i in range(0, 400, 4)], "doc_id long, level int")
    got = {r["doc_id"]: r["level"] for r in R.reading_levels(df, labels).collect()}
    assert np.mean([abs(got[i] - (1 + i % 5)) for i in range(400) if i % 4]) < 0.6


def test_whole_texts_tell_the_language():
    text = "habari ya asubuhi " * 9_000
    whole = R.trigram_counts(text + "zzzz")
    assert whole.sum() == len(text) + 4 and (whole - R.trigram_counts(text)).clip(0).sum() >= 3
    guess = R.LanguageGuess([(lang, int(g), int(n)) for lang, t in (("a", "habari ya"), ("b", "zzzz qqqq")) for g, n in enumerate(R.trigram_counts(t)) if n])
    assert guess("habari") == "a" and guess("q " + "zzzz " * 40_000) == "b" and guess("") is None


def test_measures_know_the_layout():
    body = ["Cat sat on the red mat.", "Dog ran to the big farm!"]
    for text in (" ".join(body), "\n".join(body), "1) " + "\n2) ".join(body), "A: " + "\nB: ".join(body), "[um] " + "\n\n".join(body), "cat sat on the red mat\ndog ran to the big farm"):
        n, length, _, sentence = R.measure(text)
        assert n == 12 and np.isclose(np.exp(sentence) - 1, 6), text
    assert R.measure("cat sat on the red mat dog ran")[3] is None
    assert R.measure(None) == R.measure("") == R.measure("... 12") == (0, 0.0, 0.0, None)
