import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from stageledger.llm import pii_bootstrap as pb
from stageledger.llm import queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(digits[::2] + [d * 2 - 9 * (d > 4) for d in digits[1::2]]) % 10 == 0


def brute(text):
    """Base spans by the contract's own expressions."""
    found = []
    for kind, expression in PLAIN.items():
        for m in re.finditer(expression, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[kind]
            if ok:
                found.append((m.start(), list(PLAIN).index(kind), m.end()))
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(found))


def write(folder, texts, ids=None):
    pd.DataFrame({"doc_id": pd.array(ids or range(len(texts)), dtype="Int64"), "text": texts, "spans": "clash", "pos": 3, "uid": 1}).to_parquet(folder / "documents.parquet")
    return str(folder)


def check(rows, texts):
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        spans = brute(t)
        kinds = [s.partition(":")[0] for s in spans.split(",")]
        r = by[i]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), (t[:200], spans, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in PLAIN]
        assert set(spans.split(",")) - {""} <= set(r.spans.split(","))


def test_base_is_the_contracts(spark, tmp_path):
    rng = random.Random(5)
    made = ["a@b.c@d.e", "x_a@b.c_x@d.e", "a@b.co_x@c.d", "a@b@c.d", "@x.y", "+@a.b..c", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.0.0.01 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "+1 (743) 555-3824", "+1 ( - ) 555 - 38241234", "+12", "+1\n555 123 4567", "tel:+1.743.555.3824.", "é +1 743 555 3824 🎉 a@b.c", "5 " * 400, "9" * 3000, "a" * 3000 + "@", "a@" + "b." * 2000 + "c", "1." * 2000, "+" + "1 " * 500, "a@b." * 300, "(1) (2) -- 4111111111111111", None, "", " ", "\x85a@b.c 4111111111111111"]
    pieces = ["a", "b", "7", "4", "1", "@", ".", "+", "-", "(", ")", " ", "\n", "_", "%", "é", "4111111111111111", "+1 (743) 555-3824", "10.0.0.1", "x@y.z"]
    made += ["".join(rng.choice(pieces) for _ in range(rng.choice([4, 12, 40]))) for _ in range(1500)]
    check(queries.queries()["op12_bootstrapped_pii"](spark, write(tmp_path, made)).collect(), made)


def number(rng):
    while True:
        n = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(n):
            return n


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Seeds in known contexts; unseen forms in the same contexts; look-alikes elsewhere."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda: " ".join(word() for _ in range(8))
    phone = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = [f"{prose()} please call +1 {phone()} today {prose()}" for _ in range(60)] + [f"{prose()} card {number(rng)} {prose()}" for _ in range(40)]
    cards = [number(rng), number(rng)]
    texts += [f"{prose()} {cards[0]} {cards[1]} {prose()}", f"{prose()} please call {phone()} today {prose()}", f"+1 {phone()} 10.20.30.40 {prose()}"]
    texts += [f"{prose()} built on 2024-01-{i:02d} in {1000 + i} rooms, version 2.0.{i} of {prose()}" for i in range(28)]
    texts += [f"{prose()} order 7536784127813051 {prose()}"] + [f"{prose()} serial 555-0100-{i:04d} shipped {prose()}" for i in range(20)]
    return texts, queries.queries()["op12_bootstrapped_pii"](spark, write(tmp_path_factory.mktemp("pii"), texts)).collect()


def test_unseen_identifiers_are_found(found):
    texts, rows = found
    check(rows, texts)
    added = {r.doc_id: [tuple(s.split(":")) for s in r.spans.split(",") if s and s not in brute(texts[r.doc_id]).split(",")] for r in rows if r.n_added}
    text = {i: [(k, texts[i][int(a) : int(b)]) for k, a, b in spans] for i, spans in added.items()}
    assert sorted(text) == [100, 101, 102], text
    assert [k for k, _ in text[100]] == ["card", "card"] and " ".join(t for _, t in text[100]) in texts[100]
    assert text[101][0][0] == "phone" and re.fullmatch(r"\(\d{3}\) 555-\d{4}", text[101][0][1])
    assert text[102][0][0] == "phone" and text[102][0][1].startswith("+1 (")


def test_copies_lend_no_confidence(spark, tmp_path):
    one = "so please ring +1 (743) 555-3824 at noon"
    other = "so please ring (743) 555-3825 at noon"
    texts = [one] * 500 + [other]
    rows = queries.queries()["op12_bootstrapped_pii"](spark, write(tmp_path, texts)).collect()
    assert all(r.n_added == 0 for r in rows)  # a single seed, whatever its copies


def test_rows_are_rows(spark, tmp_path, none):
    folder = write(tmp_path, ["a@b.c", "a@b.c", None, "4111111111111111"], [7, 7, 8, None])
    df = queries.queries()["op12_bootstrapped_pii"](spark, folder)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    rows = df.collect()
    assert sorted((r.doc_id or -1, r.n_email, r.n_card, r.spans) for r in rows) == [(-1, 0, 1, "card:0:16"), (7, 1, 0, "email:0:5"), (7, 1, 0, "email:0:5"), (8, 0, 0, "")]
    assert pb.extract(none).collect() == []


def test_long_texts(spark, tmp_path):
    texts = ["word " * 200_000 + "a@b.c", "z" * 1_000_000, "12 34 " * 10_000]
    check(queries.queries()["op12_bootstrapped_pii"](spark, write(tmp_path, texts)).collect(), texts)


def test_reads_the_driver_tables_alike(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    rows = queries.queries()["op12_bootstrapped_pii"](spark, folder).collect()
    assert len(rows) == len(texts) and all(r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest() for r in rows)
