import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from stageledger.llm import packing as pk
from stageledger.llm.tokens import Encoder, vocabulary_path


@pytest.mark.parametrize("groups", [4, 96, 896, None])
def test_plans_hold_every_item_once(groups):
    rng = random.Random(4)
    histogram = defaultdict(int)
    for _ in range(4000):
        n = max(1, int(rng.lognormvariate(6, 1.1)))
        histogram[(n - 1) % 1024 + 1] += 1
    count, runs = pk.plan(dict(histogram), groups=groups)
    ranks, used = defaultdict(set), defaultdict(list)
    for n, rank, c, sequence, offset in runs:
        for i in range(c):
            assert rank + i not in ranks[n]
            ranks[n].add(rank + i)
            used[sequence + i].append((offset, n))
    assert all(ranks[n] == set(range(c)) for n, c in histogram.items()) and len(used) == count
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and own[-1][0] + own[-1][1] <= 1024


def test_plan_is_near_the_bound():
    rng = random.Random(5)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[rng.randint(1, 700)] += 1
    total = sum(n * c for n, c in histogram.items())
    assert pk.plan(dict(histogram))[0] <= 1.005 * -(-total // 1024) + 1


def test_grouping_needs_no_more_sequences_than_best_fit():
    rng = random.Random(6)
    kinds = [lambda: rng.randint(257, 400), lambda: rng.randint(300, 700), lambda: rng.randint(200, 500), lambda: rng.randint(1, 1024), lambda: rng.choice([rng.randint(500, 530), rng.randint(330, 345), rng.randint(240, 270)])]
    for kind in kinds:
        for n in (300, 5000):
            histogram = Counter(kind() for _ in range(n))
            assert pk.plan(histogram)[0] <= pk.plan(histogram, groups=None)[0]


@pytest.mark.parametrize("sf, grouped", [("0.001", 193), ("0.01", 964), ("0.1", 9872)])
def test_sequences_of_the_tables(sf, grouped):
    """Plain best-fit needs as many there; the bound by bytes is 192, 962 and 9871."""
    path = f"/root/testdata/sf{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    e, histogram = Encoder.of(vocabulary_path(pk.VOCABULARY)), Counter()
    for ids in e.encode(pq.read_table(path, columns=["text"]).column("text").to_pylist()):
        n = len(ids) // 4 + 1
        histogram[(n - 1) % 1024 + 1] += 1
        histogram[1024] += (n - 1) // 1024
    assert pk.plan(histogram)[0] == grouped


def test_documents(spark, odd, none):
    e = Encoder.of(vocabulary_path(pk.VOCABULARY))
    got = pk.pack_documents(odd).collect()
    rows, by = defaultdict(list), defaultdict(list)
    for r in got:
        rows[r.doc_id, r.uid].append(r)
        by[r.sequence_id].append(r)
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append([*np.frombuffer(e.whole([r.text or ""])[0] if r.text else b"", "<u4"), 2])
    assert len(rows) == odd.count()
    for (doc, _), own in rows.items():
        own.sort(key=lambda r: r.piece)
        ids = next(x for x in texts[doc] if len(x) == sum(r.length for r in own))
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert all(r.length == 1024 for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) <= 1024
    assert pk.pack_documents(none).count() == 0
