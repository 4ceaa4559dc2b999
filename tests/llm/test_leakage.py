import random

from nyuzi.llm import leakage as L


def brute_run(item, text, rule=L.Rule()):
    """Longest run of the item within its budget: every start in both, full table of edits."""
    best = 0
    for i in range(len(item)):
        for j in range(len(text) + 1):
            row = list(range(len(text) - j + 1))
            for k, w in enumerate(item[i:], 1):
                new = [k]
                for m, v in enumerate(text[j:], 1):
                    new.append(min(row[m] + 1, new[-1] + 1, row[m - 1] + (w != v)))
                row = new
                if min(row) <= int(k * rule.changed):
                    best = max(best, k)
    return best


def test_longest_run_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(8, 24))]
        a = rng.randrange(len(item))
        copied = item[a : a + rng.randint(4, 24)]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(copied))
            copied[at : at + rng.randint(0, 1)] = rng.choice([["x"], [], ["y", copied[at]]])
            copied = copied or ["z"]
        text = [rng.choice("abcxyz") for _ in range(6)] + copied + [rng.choice("abcxyz") for _ in range(6)]
        rule = L.Rule(0.5, 0.1)
        got, want = L.longest_run(item, text, rule), brute_run(item, text, rule)
        assert got == want, (item, text)


def corpus(rng):
    words = ["".join(rng.choice("bdgkmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: pick(rng.randint(27, 60)) for i in range(25)}
    docs, n = {}, 0
    for i, item in items.items():
        for part, edits in ((1.0, 0), (1.0, 3), (0.6, 1), (0.55, 0), (0.3, 0), (0.1, 0)):
            size = int(len(item) * part)
            a = rng.randint(0, len(item) - size)
            run = item[a : a + size]
            for e in range(edits):
                run[(e + 1) * len(run) // (edits + 1) - 1] = "zzz"
            layout = rng.choice([" ", "\n"])
            docs[n] = " ".join(pick(40)) + ".\nB: " + layout.join(run).capitalize() + "! [noise] " + " ".join(pick(40))
            n += 1
        shuffled = list(item)
        rng.shuffle(shuffled)
        docs[n] = " ".join(shuffled)
        n += 1
    return items, docs


def test_search_against_alignment_of_whole_texts(spark):
    items, docs = corpus(random.Random(8))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = {(i, d) for i, w in items.items() for d, t in docs.items() if L.longest_run(w, L.document_words(t)) >= len(w) * 0.5}
    assert len(want) >= 75
    got = [tuple(r) for r in L.find_leaks(df, held).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in L.find_leaks(df, held, block=2000).collect()} == want


def planted(rng, n):
    """An item of ``n`` words, and a text with a run of it with as many words changed, added or left out as its own budget allows."""
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(a, b)))
    item = [word(1, 9) for _ in range(n)]
    size = rng.choice([-(-n // 2), n, rng.randint(-(-n // 2), n)])
    a = rng.randint(0, n - size)
    run = item[a : a + size]
    for at in sorted(rng.sample(range(size), int(size * 0.1)), reverse=True):
        run[at : at + rng.choice([0, 1, 1])] = rng.choice([[word(1, 3)], [word(10, 30)], []])
    return item, [word(1, 9) for _ in range(rng.randint(0, 60))] + run + [word(1, 9) for _ in range(rng.randint(0, 60))]


def test_filter_loses_no_run_that_alignment_accepts():
    rng, rule, met = random.Random(12), L.Rule(), 0
    for trial in range(400):
        n = rng.randint(8, 120) if trial % 10 else rng.choice([1, 3, 5, 200, 400])
        item, text = planted(rng, n)
        want = L.longest_run(item, text, rule) >= n * rule.part
        met += want
        assert L._leaks_of(" ".join(text), L.Items([item], rule)) == ([0] if want else []), (item, text)
    assert met > 340


def test_named_losses_of_the_earlier_bounds():
    rng, rule = random.Random(2), L.Rule()
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for n, size, changed, added in ((18, 10, 1, 0), (38, 20, 2, 0), (200, 110, 0, 9), (400, 220, 0, 18)):
        for _ in range(20):
            item = [word(rng.randint(2, 8)) for _ in range(n)]
            run = item[:size]
            for at in rng.sample(range(1, size - 1), changed):
                run[at] = word(12)
            for at in sorted(rng.sample(range(1, size - 1), added), reverse=True):
                run.insert(at, word(12))
            assert L._leaks_of(" ".join(run), L.Items([item], rule)) == [0]


def test_counts_are_added_up_over_slices(monkeypatch):
    rng = random.Random(4)
    cases = [planted(rng, 40) for _ in range(20)]
    items = L.Items([c[0] for c in cases])
    whole = [L._leaks_of(" ".join(c[1] * 3), items) for c in cases]
    monkeypatch.setattr(L, "SLICE", 50), monkeypatch.setattr(L, "MOST_HITS", 7)
    assert [L._leaks_of(" ".join(c[1] * 3), items) for c in cases] == whole and all(i in w for i, w in enumerate(whole))


def test_odd_rows(spark):
    item = "moja mbili tatu nne tano sita saba nane tisa kumi na moja na mbili na tatu"
    docs = [(1, None), (2, ""), (3, item.upper().replace(" ", "\n")), (4, "x " * 100_000 + item), (None, item), (5, item + " " + item), (3, item), (6, "[moja mbili]")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    got = sorted((r["item_id"], r["doc_id"] or 0) for r in L.find_leaks(df, held).collect())
    assert got == [(1, 0), (1, 3), (1, 3), (1, 4), (1, 5)]
