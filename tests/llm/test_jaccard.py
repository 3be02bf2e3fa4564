import random

import numpy as np
import pytest

from stageledger.llm import jaccard_join as jj


def sets(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, threshold):
    num, den = threshold
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(d, sets(t, size)) for d, t in rows]
    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {d: top(d) for d, _ in own}


def corpus(seed, n, near):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(n):
        if rng.random() < near:
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 12, 30, 80]))]
            if rows and rng.random() < 0.5:
                w = rng.choice(rows)[1].split()
                w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("threshold", [(17, 20), (4, 5)])
def test_linked_sets_share_a_signature(threshold):
    rng = np.random.default_rng(3)
    num, den = threshold
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = rng.integers(0, max(1, n // 10) + 1)
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64))))
        if len(b) and jj.linked(a, b, threshold):
            both = np.intersect1d(jj.signatures(a, threshold), jj.signatures(b, threshold))
            assert len(both), (len(a), len(b))


@pytest.mark.parametrize("small_bucket", [32, 2])
def test_components_match_brute_force(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(jj, "SMALL_BUCKET", small_bucket)  # 2: large buckets' blocks do the work
    monkeypatch.setattr(jj, "BLOCK_ROWS", 7)
    rows = corpus(11, 160, 0.4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(docs).collect()}
    expected = brute(rows, 4, (17, 20))
    assert got == {d: (len(sets(t, 4)), expected[d]) for d, t in rows}


def test_odd_rows(spark, odd, none):
    got = jj.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[0, 5] == by[1, 5] == by[2, 5] == 0 and by[9, 5] == 9
    assert by[4, 0] == 4 and by[5, 0] == 5 and by[6, 1] == 6 and by[None, 1] == 6 and by[None, 0] is None
    assert jj.jaccard_components(none).count() == 0


@pytest.mark.parametrize("small_bucket", [32, 2])
def test_null_ids_link_by_their_texts(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(jj, "SMALL_BUCKET", small_bucket)
    words = [f"w{i}" for i in range(120)]
    swap = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    # 1 and 2 are too far apart, and meet by way of the row between them only.
    rows = [(1, swap(10, 60)), (2, swap(30, 90)), (None, swap()), (None, "p q r s t"), (7, "other words all along here")]
    assert not jj.linked(*[next(jj.shingle_sets([t])) for _, t in rows[:2]])
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 117): 1, (2, 117): 1, (None, 117): 1, (None, 2): None, (7, 2): 7}


def test_pipeline_keeps_one_row_of_each_group_of_null_ids(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(120)]
    near = lambda head, i: " ".join([head, *words[:i], "x", *words[i:]])
    other = lambda i: " ".join(f"{w}{'y' if k == i else 'z'}" for k, w in enumerate(words))
    rows = [(None, near("a", 10)), (None, near("a", 50)), (None, near("a", 50)), (4, near("a", 90)), (5, near("a", 90))]
    rows += [(None, other(i)) for i in (3, 60, 110)] + [(None, None), (None, None), (None, ""), (8, "")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [4, 8]
    texts = [r.text for r in kept if r.doc_id is None]
    assert len(texts) == 3 and None in texts and "" in texts and texts.count(None) == 1
