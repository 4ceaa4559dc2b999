import random

from hypothesis import given
from hypothesis import strategies as st

from nyuzi.llm import overlap as O
from nyuzi.llm.textnorm import sentence_key, sentence_words


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12), st.integers(0, 6))
def test_banded_distance(a, b, most):
    assert O.edit_distance(a, b, most) == min(full_distance(a, b), most + 1)


def near(a, b):
    x, y = a.split(), b.split()
    p, q = "".join(x), "".join(y)
    return full_distance(x, y) <= max(len(x), len(y)) / 6 or full_distance(p, q) <= max(len(p), len(q)) / 10


def made_up(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnrst") + rng.choice("aeiouĩũ") for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        base = [word() for _ in range(rng.randint(4, 14))]
        copies = [list(base)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            c = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(c))
                kind = rng.random()
                if kind < 0.3:
                    c[at] = word()
                elif kind < 0.5:
                    c.insert(at, word())
                elif kind < 0.7 and len(c) > 2:
                    del c[at]
                else:
                    w = c[at]
                    k = rng.randrange(len(w))
                    c[at] = w[:k] + rng.choice("aeiou") + w[k + 1 :]
            copies.append(c)
        for c in copies:
            rows.append((len(rows), (" ".join(c)).capitalize() + rng.choice(["", ".", " [um]", "!"]), rng.choice(["train", "Train ", "dev", "validation", "test", "TEST", None, ""])))
    return rows


def test_pairs_against_brute_force(spark):
    rows = made_up(4, 220)
    df = spark.createDataFrame(rows, "utt_id long, text string, split string")
    got = {tuple(r) for r in O.cross_split_pairs(df, "utt_id", "text", "split").collect()}
    side = lambda s: {"train": 1, "dev": 2, "validation": 2, "test": 2}.get((s or "").strip().lower())
    keyed = [(i, sentence_key(t), side(s)) for i, t, s in rows if side(s) and len(sentence_words(t)) >= 5]
    want = {(min(a, b), max(a, b)) for a, k, s in keyed if s == 1 for b, m, t in keyed if t == 2 and (k == m or near(k, m))}
    assert len(want) > 30 and got == want


def test_one_long_word_of_six_is_found(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        base = ["".join(rng.choice("bdgkmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 2))) for _ in range(6)]
        for split in ("train", "dev"):
            base[i % 6] = "".join(rng.choice("prstvw") + rng.choice("aeiou") for _ in range(12))
            rows.append((2 * i + (split == "dev"), " ".join(base), split))
    df = spark.createDataFrame(rows, "utt_id long, text string, split string")
    got = {tuple(r) for r in O.cross_split_pairs(df, "utt_id", "text", "split").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(150)}


def test_one_letter_in_ten_anywhere_is_found(spark):
    rng = random.Random(13)
    rows = []
    for i in range(150):
        words = ["".join(rng.choice("bdgkmnprstvw") + rng.choice("aeiou") for _ in range(5)) for _ in range(6)]
        rows.append((2 * i, " ".join(words), "train"))
        rows.append((2 * i + 1, " ".join(w[:4] + "ũ" + w[5:] for w in words), "test"))
    df = spark.createDataFrame(rows, "utt_id long, text string, split string")
    got = {tuple(r) for r in O.cross_split_pairs(df, "utt_id", "text", "split").collect()}
    want = {(2 * i, 2 * i + 1) for i in range(150)}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_repeated_words_and_long_texts_lose_no_pair():
    rng = random.Random(3)
    pairs = [("ndio ndio ndio ndio ndio mwalimu", "ndio ndio ndio ndio ndio shuleni"), ("la la la la la hapana", "la la la la la karibuni"), ("haba ri gani bwana mkubwa sana", "habari gani bwana mkubwa sana")]
    for _ in range(400):
        few = ["".join(rng.choice("aeiou" if i % 2 else "bdgk") for i in range(rng.randint(1, 8))) for _ in range(rng.choice([2, 3, 20]))]
        a = [rng.choice(few) for _ in range(rng.randint(6, 40))]
        b = list(a)
        for at in rng.sample(range(len(b)), rng.randint(0, len(b) // 6)):
            b[at] = rng.choice([*few, "kabisa"])
        c = list(" ".join(b))
        for _ in range(rng.randint(0, len(c) // 9)):
            c[rng.randrange(len(c))] = rng.choice("aeiou ")
        pairs.append((" ".join(a), " ".join("".join(c).split()) or "x"))
    got, jaccard = O.verify(*map(list, zip(*pairs)))
    assert [bool(x) for x in got] == [near(x, y) for x, y in pairs] and 100 < got.sum() < 400 and got[:3].all()
    assert ((jaccard > 0) & (jaccard <= 1))[:3].all()
    long = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    other = "".join(rng.choice("ijkl") if rng.random() < 0.05 else c for c in long)
    assert O.nearly_same(long, other) and not O.nearly_same(long, long[::-1])


def test_repeated_words_meet(spark):
    few = ["ndio", "la", "sawa"]
    rows = [(2 * i, f"{few[i % 3]} " * (5 + i % 4) + f"mwalimu{i}", "train") for i in range(60)]
    rows += [(r[0] + 1, r[1].replace("mwalimu", "shuleni kwa")[: -len(str(i))] if i % 2 else r[1].rsplit(" ", 1)[0] + " karibuni", "dev") for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "utt_id long, text string, split string")
    got = {tuple(r) for r in O.cross_split_pairs(df, "utt_id", "text", "split").collect()}
    assert got == {(min(a, b), max(a, b)) for a, x, s in rows if s == "train" for b, y, t in rows if t == "dev" and near(x, y)}


def test_copies_and_odd_rows(spark):
    t = "moja mbili tatu nne tano sita saba"
    rows = [(1, t, "train"), (2, t.upper() + "!", "dev"), (3, t, "test"), (4, t, None), (5, None, "train"), (6, "", "dev"), (7, "fupi tu", "train"), (8, "fupi tu", "dev"), (9, t, "train"), (None, t, "dev"), (10, "neno " * 30_000, "train"), (11, "neno " * 30_000 + "x", "dev")]
    df = spark.createDataFrame(rows, "utt_id long, text string, split string")
    got = sorted(tuple(r) for r in O.cross_split_pairs(df, "utt_id", "text", "split").collect())
    assert got == [(1, 2), (1, 3), (2, 9), (3, 9), (10, 11)]


def test_report_counts_rows_once(spark):
    t = "moja mbili tatu nne tano sita saba"
    rows = [(i, t, "train", "a") for i in range(50)] + [(100 + i, t, "dev", "a") for i in range(40)] + [(200, t + " nane", "test", "b"), (201, "kitu kingine kabisa hapa sasa leo", "test", "b")]
    df = spark.createDataFrame(rows, "utt_id long, text string, split string, source string")
    got = sorted(tuple(r) for r in O.overlap_report(df, "utt_id", "text", "split", "source").collect())
    assert got == [("dev", "a", 40, 40, 0), ("test", "b", 2, 0, 1)]


def test_sentence_words():
    assert sentence_words("Ng'ũ—a, [pause] B.C 3.5 ｗｉｄｅ x​y ng’ũ") == ["ngũa", "bc", "35", "wide", "xy", "ngũ"]
    assert sentence_words(None) == sentence_words("") == sentence_words(" [um] — ") == []
    assert sentence_words("ũ Ũ") == ["ũ", "ũ"] and sentence_words("mер жол") == ["mep", "жол"]
