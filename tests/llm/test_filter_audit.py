import random
from collections import Counter
from itertools import permutations

import duckdb
import pandas as pd
import pytest
from oracle import same
from pyspark.sql import functions as F

from stageledger.llm import filter_audit as fa
from stageledger.llm import queries


def failing(docs):
    """Letters that each row fails, by plain Python."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if x]
        bad = set()
        if len(w) < 50:
            bad.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            bad.add("E")
        out.append(bad)
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    bad = failing(docs)
    rows, shapley = {}, Counter()
    for part in {s or "" for _, _, s in docs}:
        own = [(d, b) for d, b in zip(docs, bad, strict=True) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                fails = sum(f in b for _, b in own)
                rows[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(b == {f} for _, b in own), sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(1)
    docs = []
    for i in range(120):
        w = [rng.choice(["ab", "cd", "Ef", "gh", "ij%"][: rng.randint(1, 5)]) + str(rng.randrange(rng.choice([2, 500]))) for _ in range(rng.choice([3, 49, 50, 80]))]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w), f"s{i % 3}"))
    docs += [(200, docs[5][1], "s0"), (5, docs[5][1], "s1"), (None, docs[5][1], "s1"), (201, None, None), (202, "", None), (203, " \n", "s0"), (204, "x " * 20_000, "s2"), (205, "É " * 60, "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    folder = tmp_path_factory.mktemp("audit")
    ints = lambda x: pd.array(x, dtype="Int64")
    pd.DataFrame({"doc_id": ints([d[0] for d in docs]), "text": [d[1] for d in docs], "source": [d[2] for d in docs], "part": "clash", "copied": 1}).to_parquet(folder / "documents.parquet")
    pd.DataFrame({"doc_id": ints([x[0] for x in labels]), "quality": ints([x[1] for x in labels]), "toxic": ints([x[2] for x in labels]), "good": "clash"}).to_parquet(folder / "labels.parquet")
    return str(folder), docs, labels


def test_against_brute_force_and_sql(spark, tables):
    folder, docs, labels = tables
    df = queries.queries()["op13_permutation_trie"](spark, folder)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}
    assert got == brute(docs, labels) and len(got) == 600 * 4
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert same(df, c, fa.ORACLE) == 2400


def test_states_are_shared(spark):
    rows = [("p", bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8)]
    trie = fa.Trie(spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean"), "XYZ")
    edges = trie.walk().collect()
    assert len(trie.edges) == 7 and len(edges) == 12  # of 8 states and 15 inner nodes of the full trie; 3 * 4 edges
    assert {(e.state, e.filter): (e.entered, e.removed) for e in edges}["XZ", "Y"] == (2, 1)
    spark_ids = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert spark_ids == 0  # no survivors stay persisted
    trie.discard()


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = fa.failures(none, labels)
    assert fa.audit(found, fa.FILTERS, counts={"good_lost": "good", "toxic_lost": "toxic"}).collect() == []


def test_hot_text(spark):
    docs = spark.range(3000).select((F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words").otherwise(F.col("id").cast("string")).alias("text"), F.lit("hot").alias("source"))
    found = fa.failures(docs, spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int"))
    assert found.where("E").count() == 999 and found.where("good and toxic").count() == 1
