import random

from stageledger.llm import decontamination as dc


def plain_distance(item, text):
    before, best = list(range(len(item) + 1)), len(item)
    for c in text:
        now = [0]
        for i, x in enumerate(item):
            now.append(min(before[i] + (x != c), before[i + 1] + 1, now[i] + 1))
        before = now
        best = min(best, before[-1])
    return best


def test_myers_against_the_table():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        k = rng.randint(0, 6)
        d = plain_distance(a, t)
        got = dc.myers(dc.masks(a), len(a), t, k)
        assert (got[0] if got else None) == (d if d <= k and t else None) or (not t and got is None)


def test_matches_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aehinorst") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)]
    docs = []
    for d in range(120):
        text = [word() for _ in range(40)]
        if d % 2:
            own = list(items[d % 12][1])
            for _ in range(rng.choice([0, 1, 3, 6, 12])):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            text[20:20] = ["".join(own).upper() if d % 3 == 0 else "".join(own)]
        docs.append((d, "  \n".join(text)))
    expected = set()
    for d, t in docs:
        for i, x in items:
            n = plain_distance(dc.normal(x), dc.normal(t))
            if n <= dc.budget(dc.normal(x)):
                expected.add((d, i, n))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.matches(frame, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == expected and len(expected) > 30
    dirty = {d for d, _, _ in expected}
    assert {r.doc_id for r in dc.clean(frame, bench).collect()} == {d for d, _ in docs} - dirty


def test_odd_rows(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([(1, "b c d e f"), (2, None), (3, " "), (None, "x"), (4, "b c d e f")], "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_CHARS", 3)
    got = {(r.doc_id, r.item_id) for r in dc.matches(odd, bench).collect()}
    assert got == {(d, i) for d in (0, 1, 2, 9) for i in (1, 4)}
    assert dc.clean(odd, bench).columns == odd.columns
    assert dc.matches(none, bench).count() == 0 and dc.matches(odd, bench.limit(0)).count() == 0
