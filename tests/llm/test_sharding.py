import zlib
from collections import defaultdict

from stageledger.llm import sharding as sh
from stageledger.llm.common import fresh_path, materialize


def placed(docs):
    rows = materialize(sh.digests(docs), "t")
    m = sh.store_map(sh.first_map(sh.slot_totals(rows)), fresh_path(docs.sparkSession, "t"), 1)
    return sh.place(rows, m).collect(), m


def test_places_are_gapless_and_shards_even(spark, odd, none):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text")
    got, m = placed(docs)
    by, size = defaultdict(list), defaultdict(int)
    for r in got:
        by[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        assert r["size"] == r.doc_id % 97 + 1 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 97))
    assert len(by) == 16 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(size.values()) - min(size.values()) <= 100
    got, _ = placed(odd)
    assert len(got) == odd.count()
    assert placed(none)[0] == []


def test_a_hot_slot_is_ranked_in_strips(spark):
    docs = spark.range(900).selectExpr("if(id < 600, null, id) as doc_id", "if(id < 600, 'same', cast(id as string)) as text", "'x' as uid", "1 as strip")
    got, m = placed(docs)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 900 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(r.n_rows for r in m.collect()) >= 600


def test_an_edit_moves_few_slots(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text")
    totals = materialize(sh.slot_totals(sh.digests(docs)), "t")
    one = sh.store_map(sh.first_map(totals), fresh_path(spark, "t"), 1)
    two = sh.edit_map(one, totals, 17, 2)
    a, b = ({r.virtual_slot: (r.shard, r.bytes) for r in m.collect()} for m in (one, two))
    assert a.keys() == b.keys()
    moved = sum(a[s][1] for s in a if a[s][0] != b[s][0])
    assert moved <= 1.5 * sum(x for _, x in a.values()) / 17
    load = defaultdict(int)
    for shard, n in b.values():
        load[shard] += n
    assert len(load) == 17 and max(load.values()) < 1.1 * sum(load.values()) / 17
