import itertools

import pytest
from pyspark.sql import functions as F

from stageledger.operators import batch, decide, graph, keys, rollup


def scalar_decide(failed, attempted, partial, success, key_match, missing, mismatch):
    if failed:
        return "failed", "stage-failed"
    if attempted:
        return ("resume", "resume") if partial else ("needs-run", "interrupted")
    if success and key_match:
        return ("needs-run", "artifact-missing") if missing else ("needs-run", "artifact-changed") if mismatch else ("hit", "hit")
    if partial:
        return "resume", "resume"
    return "needs-run", "why" if success else "no-cache"


def test_decide_on_every_combination(spark):
    names = ["failed", "attempted", "partial", "success", "key_match", "missing", "mismatch"]
    rows = list(itertools.product([False, True], repeat=7))
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names))
    got = {tuple(r[:7]): (r.d.status, r.d.reason) for r in df.withColumn("d", decide.decide(*map(F.col, names), F.lit("why"))).collect()}
    assert got == {r: scalar_decide(*r) for r in rows}


def test_effective_status(spark):
    rows = [(r, d) for r in ("not-applicable", "current", "changed") for d in (None, "reuse", "invalidate")]
    df = spark.createDataFrame(rows, "r string, d string")
    got = {(x.r, x.d): (x.s, x.w) for x in df.select("r", "d", decide.effective(F.lit("hit"), F.col("r"), F.col("d")).alias("s"), decide.effective_reason(F.lit("hit"), F.col("r"), F.col("d")).alias("w")).collect()}
    for (r, d), (s, w) in got.items():
        expected = ("hit", "hit") if r != "changed" or d == "reuse" else ("needs-run", "source-changed") if d else ("needs-review", "source-changed")
        assert (s, w) == expected, (r, d)


def test_review_goes_before_error(spark):
    df = spark.createDataFrame([(1, "error"), (1, "needs-review"), (2, "failed"), (2, "hit"), (3, "hit")], "g int, status string")
    assert dict(df.groupBy("g").agg(rollup.effective(F.col("status"))).collect()) == {1: "needs-review", 2: "failed", 3: "hit"}
    assert df.limit(0).agg(rollup.worst(F.col("status"))).first()[0] == "hit"


def fingerprint(df):
    return tuple(keys.dataset_fingerprint(df).first())


def test_dataset_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1, "y": 2}), (2, None, None), (2, None, None)], "i int, s string, m map<string,int>")
    assert fingerprint(df) == fingerprint(df.repartition(3))
    assert fingerprint(df) != fingerprint(df.limit(2))
    assert fingerprint(df) != fingerprint(df.limit(1).union(df.where("i = 2").limit(1)))
    swap = lambda rows: fingerprint(spark.createDataFrame(rows, "a int, b int"))
    assert swap([(None, 1)]) != swap([(1, None)])
    assert fingerprint(df.limit(0))[0] == 0


def test_closure_of_a_diamond(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "stage string, need string")
    seed = spark.createDataFrame([("d",)], "stage string")
    assert sorted(r.stage for r in graph.closure(edges, seed).collect()) == ["a", "b", "c", "d"]
    assert dict(map(tuple, graph.levels(edges).collect())) == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_explicit_null_wins_in_a_merge(spark):
    row = spark.range(1).select(keys.merge_config(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit(None).cast("string"))).alias("m")).first()
    assert row.m == {"a": None, "b": "2"}


def test_current_partial_records_win(spark):
    one = spark.createDataFrame([("s", 0, "mine")], "stage string, index int, origin string")
    two = spark.createDataFrame([("s", 0, "theirs"), ("s", 1, "theirs")], "stage string, index int, origin string")
    assert {(r.i, r.origin) for r in map(lambda x: x, batch.adopt(one, two, ["stage", "index"]).selectExpr("index as i", "origin").collect())} == {(0, "mine"), (1, "theirs")}


def test_paths_that_meet_again(spark):
    layers = [(f"{i}.{a}", f"{i - 1}.{b}") for i in range(1, 11) for a in range(4) for b in range(4)]  # 4 ** 10 paths
    edges = spark.createDataFrame([*layers, *[(f"c{i}", f"c{i - 1}") for i in range(1, 21)]], "stage string, need string")
    top = dict(map(tuple, graph.levels(edges).collect()))
    assert len(top) == 44 + 21 and top["c20"] == 20 and all(top[f"{i}.{a}"] == i for i in range(11) for a in range(4))
    up = {r.stage for r in graph.closure(edges, spark.createDataFrame([("10.2",)], "stage string")).collect()}
    assert up == {"10.2", *(f"{i}.{a}" for i in range(10) for a in range(4))}


def test_a_long_chain(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 201)], "stage string, need string")
    seeds = spark.createDataFrame([("c150",)], "stage string")
    assert {r.stage for r in graph.closure(edges, seeds).collect()} == {f"c{i}" for i in range(151)}


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "x"), ("x", "e")], "stage string, need string")
    assert {r.stage for r in graph.closure(edges, spark.createDataFrame([("a",)], "stage string")).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([("a", "root"), ("a", "b"), ("b", "a")], "stage string, need string"))


@pytest.mark.parametrize("block", [500_000, 40])
def test_levels_and_closures_by_blocks(spark, monkeypatch, block):
    """Deep and dense graphs, in one block and in many, against plain Python."""
    monkeypatch.setattr(graph, "BLOCK", block)
    n = 1000 if block > 100 else 100
    edges = [(f"c{i + 1:04d}", f"c{i:04d}") for i in range(n)] + [(f"d{i:02d}", f"d{j:02d}") for i in range(16) for j in range(i)]
    edges += [("d03", f"c{n:04d}"), ("w", "c0003"), ("w", "c0003"), ("w", "d05"), (None, "c0001"), ("c0001", None), ("e1", "w"), ("e2", "e1")]
    needs = {}
    for s, u in edges:
        if s and u:
            needs.setdefault(s, set()).add(u)
    level = {}
    for s in [f"c{i:04d}" for i in range(n + 1)] + [f"d{i:02d}" for i in range(16)] + ["w", "e1", "e2"]:
        level[s] = 1 + max((level[u] for u in needs.get(s, ())), default=-1)
    df = spark.createDataFrame(edges, "stage string, need string")
    assert dict(map(tuple, graph.levels(df).collect())) == level
    found, stack = {"e1"}, ["e1"]
    while stack:
        for u in needs.get(stack.pop(), ()):
            if u not in found:
                found.add(u)
                stack.append(u)
    assert sorted(r.stage for r in graph.closure(df, spark.createDataFrame([("e1",), (None,)], "stage string")).collect()) == sorted(found)


def test_dense_graph(spark):
    edges = spark.createDataFrame([(f"s{i}", f"s{j}") for i in range(300) for j in range(i)], "stage string, need string")
    assert dict(map(tuple, graph.levels(edges).collect())) == {f"s{i}": i for i in range(300)}


@pytest.mark.parametrize("block", [500_000, 2])
@pytest.mark.parametrize("cycle", [[("a", "b"), ("b", "a"), ("x", "r")], [("a", "b"), ("b", "c"), ("c", "a")], [("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("a", "r"), ("b", "r"), ("c", "r"), ("z", "a")]])
def test_cycles_are_named(spark, monkeypatch, block, cycle):
    monkeypatch.setattr(graph, "BLOCK", block)
    with pytest.raises(ValueError, match="cycle.*: .*a"):
        graph.levels(spark.createDataFrame(cycle, "stage string, need string"))


def test_no_edges(spark):
    none = spark.createDataFrame([], "stage string, need string")
    assert graph.levels(none).collect() == [] and graph.closure(none, none).collect() == []


def plain_tree(items, fan):
    import hashlib

    digest = lambda part: "sha256:" + hashlib.sha256("\n".join(part).encode()).hexdigest()
    nodes = [digest(items[i : i + fan]) for i in range(0, len(items), fan)]
    while len(nodes) > 1:
        nodes = [p[0] if len(p) == 1 else digest(p) for p in (nodes[i : i + fan] for i in range(0, len(nodes), fan))]
    return nodes[0]


def test_digest_tree(spark):
    groups = {"one": 1, "full": 8, "more": 9, "many": 700, None: 5}
    rows = [(g, i, f"item {i}" if i % 5 else None) for g, n in groups.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, item string").repartition(6)
    got = {r.g: (r.fingerprint, r.members) for r in keys.ordered_hash(df, ["g"], ["k"], F.col("item"), 8).collect()}
    assert got == {g: (plain_tree([f"item {i}" if i % 5 else "" for i in range(n)], 8), n) for g, n in groups.items()}


def test_digest_tree_of_a_large_group(spark):
    """A million members of one group; no row ever holds more than a node's digests."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    row = keys.ordered_hash(df, ["g"], ["k"], F.col("k").cast("string")).first()
    assert (row.fingerprint, row.members) == (plain_tree([str(i) for i in range(1_000_000)], 1024), 1_000_000)


def test_portable_doubles(spark):
    import math
    import random

    rng = random.Random(9)
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 2.0**52, 2.0**-1022, 5e-324, 1.7976931348623157e308, math.inf, -math.inf, math.nan, None]
    values += [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randint(-1000, 1000)) for _ in range(200)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 37)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", keys.exact_double(F.col("x")).alias("t")).collect()
    for r in got:
        if r.x is None or r.x != r.x or math.isinf(r.x) or r.x == 0:
            assert r.t == (None if r.x is None else "nan" if r.x != r.x else "0" if r.x == 0 else "+inf" if r.x > 0 else "-inf")
        else:
            sign, e, bits = r.t[0], *map(int, r.t[1:].split(":"))
            assert (1 + bits / 2**52) * 2.0**e * (-1 if sign == "-" else 1) == r.x if e > -1023 else True
    assert len({r.t for r in got}) == len({str(v) if v else "0" if v is not None else None for v in values})


def test_portable_fingerprint(spark):
    one = spark.createDataFrame([(1, None, 2.5), (None, "a", None), (1, None, 2.5)], "x long, y string, z double")
    swapped = spark.createDataFrame([(1, "a", 2.5), (None, None, None), (1, None, 2.5)], "x long, y string, z double")
    take = lambda df: tuple(keys.dataset_fingerprint(df, keys.portable_hash).first())
    assert take(one) == take(one.repartition(3)) != take(swapped) and take(one)[1:] != take(one.distinct())[1:]
    with pytest.raises(TypeError, match="portable"):
        keys.portable_hash(spark.range(1).select(F.array("id").alias("a")), 1)
