"""The registered queries without a SQL twin, each against a brute-force version on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_quality import brute_statistics

from stageledger.llm import decontamination as dc
from stageledger.llm import html_extraction as hx
from stageledger.llm import packing as pk
from stageledger.llm import quality_classifier as qc
from stageledger.llm import quality_rules as qr
from stageledger.llm import queries, sharding
from stageledger.llm.tokens import vocabulary_path


def made_documents():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(600)]
    rows = []
    for i in range(90):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 90, 200]))]
        if i % 3 == 2:
            w = [x + rng.choice(["***", "###", "%%", ""]) for x in w]
        rows.append((i, " ".join(w).capitalize() + "."))
    rows += [(100 + i, rows[i][1]) for i in range(6)]  # copies
    for i in range(8):  # near copies
        w = rows[[j for j, (_, t) in enumerate(rows) if len(t.split()) == 200][i % 3]][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, ""), (301, None), (302, "x " * 4000), (303, "line one\nline one\nline two <|endoftext|> é"), (304, "a b c " * 40)]
    return rows


def made_items(rows):
    long = [t for _, t in rows if t and len(t.split()) == 200]
    items = [(i, " ".join(t.split()[20:50])) for i, t in enumerate(long[:5])]
    off = items[1][1].split()
    off[4] = off[4][:-1] + "q"
    return [*items, (10, " ".join(off)), (11, "nothing like this is anywhere in the table at all"), (12, ""), (13, None)]


def made_pages():
    page = "<html><head><title>t</title></head><body><nav>menu {i}</nav><article><h1>Head {i}</h1><p>Story {i} of {j}</p><div class=box>Follow us</div></article><section><p>More {k}</p></section><div class=same>Office</div><footer>end</footer></body></html>"
    plain = "<body><div id=top>Welcome</div><div id=mid><p>Number {i}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.replace("{i}", str(i)).replace("{j}", str(i * 7)).replace("{k}", str(i % 5))) for i in range(9)]
    rows += [(20 + i, f"http://b.example/{i}", plain.replace("{i}", str(i))) for i in range(5)] + [(30, "http://b.example/0", plain.replace("{i}", "0")), (31, None, None), (32, "x", "")]
    return rows


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("tables"), made_documents()
    label = lambda i, t: 0 if "***" in t or "###" in t else 1
    pd.DataFrame({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "lang": "en", "source": "s", "n_chars": [len(t or "") for _, t in rows]}).to_parquet(folder / "documents.parquet")
    marked = [(d, label(d, t), 0) for d, t in rows if d < 90]
    pd.DataFrame(marked, columns=["doc_id", "quality", "toxic"]).astype({"doc_id": "int64"}).to_parquet(folder / "labels.parquet")
    pd.DataFrame(made_items(rows), columns=["item_id", "text"]).to_parquet(folder / "benchmark.parquet")
    pd.DataFrame(made_pages(), columns=["page_id", "url", "html"]).to_parquet(folder / "pages.parquet")
    return str(folder)


def run(spark, tables, name):
    return queries.queries()[name](spark, tables).collect()


def ids_of(name):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(vocabulary_path(name))
    return lambda text: fresh.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, tables):
    ids, start, expected = ids_of("word_bpe_49k.json"), 0, []
    for d, t in sorted(made_documents()):
        own = [*ids(t), 1]
        expected.append((d, start, len(own), crc(own)))
        start += len(own)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, tables, "op2_token_store")) == expected


def test_op3(spark, tables):
    got, texts = run(spark, tables, "op3_virtual_slots"), dict(made_documents())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.virtual_slot < sharding.N_SLOTS
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values()) and set(by) <= set(range(16))
    # Largest slot first to the lightest shard, over again.
    bytes_, shard, loads = Counter(), {}, [0] * 16
    for r in got:
        bytes_[r.virtual_slot] += r.size
        assert shard.setdefault(r.virtual_slot, r.shard) == r.shard
    for slot, size in sorted(bytes_.items(), key=lambda x: (-x[1], x[0])):
        at = loads.index(min(loads))
        assert shard[slot] == at
        loads[at] += size


def distance(item, text):
    """Least edits of the item against any passage of the text."""
    row = np.zeros(len(text) + 1, dtype=int)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4") if text else np.zeros(0, int)
    for i, c in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        cells = np.concatenate(([i], best))
        row = np.minimum.accumulate(cells - np.arange(len(cells))) + np.arange(len(cells))
    return int(row.min())


def test_op5(spark, tables):
    rows = made_documents()
    expected = set()
    for item_id, text in made_items(rows):
        item = dc.normal(text)
        for d, t in rows:
            if item and (k := distance(item, dc.normal(t))) <= dc.budget(item):
                expected.add((d, item_id, k))
    got = run(spark, tables, "op5_pigeonhole")
    assert len(expected) > 10 and {(r.doc_id, r.item_id, r.distance) for r in got} == expected and len(got) == len(expected)


def test_op6(spark, tables):
    rows = made_documents()
    root = components([(d, t) for d, t in sorted(rows)], 4, (17, 20))
    n = {d: len({tuple((t or "").lower().split()[i : i + 4]) for i in range(max(1, len((t or "").split()) - 3))}) if (t or "").split() else 0 for d, t in rows}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, tables, "op6_part_enum")}
    assert got == {d: (n[d], root[d]) for d, _ in rows} and len({c for _, c in got.values()}) < len(rows)


def test_op7(spark, tables):
    ids, texts = ids_of("byte_bpe_50k.json"), dict(made_documents())
    got, whole, histogram = run(spark, tables, "op7_linear_grouping"), {}, Counter()
    for d, t in texts.items():
        own = whole[d] = [*ids(t), 2]
        histogram[(len(own) - 1) % 1024 + 1] += 1
        histogram[1024] += (len(own) - 1) // 1024
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == crc(whole[r.doc_id][r.start : r.start + r.length])
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for d, own in whole.items():
        first = (len(own) - 1) % 1024 + 1
        assert sorted(pieces[d]) == [(0, 0, first), *((i + 1, first + 1024 * i, 1024) for i in range(len(own) // 1024 - (first == 1024)))]
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 1024
    assert len(places) == pk.plan(histogram)[0] <= pk.plan(histogram, groups=None)[0]


def test_op8(spark, tables):
    texts, labels = dict(made_documents()), pd.read_parquet(f"{tables}/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    model = qc.fit(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    assert len(model.labels) == sum(not held(d) and bool((texts[d] or "").split()) for d in labels.doc_id)
    for r in run(spark, tables, "op8_neighbour_vote"):
        own = model.latent(*qc.term_counts(texts[r.doc_id]))
        near = sorted(zip((model.vectors @ own).tolist(), model.labels.tolist(), strict=True), reverse=True)[: qc.NEIGHBOURS]
        weights = [max(c, 0) ** qc.SHARPNESS for c, _ in near]
        expected = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else model.prior
        assert abs(r.score - expected) < 1e-3 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5)


def test_op9(spark, tables):
    """The merged tree, entropies and importance over again, host by host, in plain Python."""
    pages = made_pages()
    host = lambda u: (urlsplit(u or "").netloc if "://" in (u or "") else "").lower()
    own = {p: hx.branches(h) for p, _, h in pages}
    text = lambda b: " ".join(" ".join(b.text).split())
    nodes, seen = defaultdict(list), set()
    for p, u, _ in pages:
        found = {path: b for path, b in own[p].items() if text(b) and not b.boiler}
        same = (host(u), tuple(sorted((path, text(b)) for path, b in found.items())))
        if same not in seen:  # copies count once
            seen.add(same)
            for path, b in found.items():
                nodes[host(u), path].append((" ".join(b.children), text(b)))

    def entropy(values):
        m = len(values)
        return 1.0 if m < 2 else -sum(c / m * math.log(c / m) for c in Counter(values).values()) / math.log(m)

    expected = {}
    for p, u, h in pages:
        has, kept = any(b.article for b in own[p].values()), set()
        for path, b in own[p].items():
            if not text(b) or b.boiler:
                continue
            seen_here = nodes[host(u), path]
            e = hx.PRESENTATION * entropy([x for x, _ in seen_here]) + (1 - hx.PRESENTATION) * entropy([x for _, x in seen_here])
            alone = e if len(seen_here) >= hx.REPEATED else 1.0
            inside = 1.0 if hx._prose(path) else hx.INSIDE + alone
            beside = hx.OUTSIDE * e if len(seen_here) > 1 else 0.0
            if (inside if b.article else beside if has else alone) >= hx.LEAST:
                kept.add(path)
        expected[p] = hx.extract(h, kept)
    got = run(spark, tables, "op9_style_tree")
    assert {r.page_id: r.text for r in got} == expected and all(r.n_chars == len(r.text) for r in got)
    assert expected[3].startswith("Head 3 Story 3 of 21") and "Follow us" not in expected[3] and expected[22] == "Number 2"


def learned(rows, cuts):
    """Sequential covering straight on rows (features, fold, label)."""
    options = [(n, t, above) for n in qr.FEATURES for t in cuts[n] for above in (True, False)]
    holds = lambda rule, x: all((x[n] > t) == above for n, t, above in rule)
    laplace = lambda own: (sum(y == 0 for y in own) + 1) / (len(own) + 2)
    rules, left = [], list(rows)
    least = qr.MIN_COVER_SHARE * sum(y == 0 for _, _, y in rows)
    labels = lambda rule, folds: [y for x, f, y in left if f in folds and holds(rule, x)]
    while len(rules) < qr.MAX_RULES:
        rule, best = [], (laplace(labels([], (0,))), 0)
        while len(rule) < qr.MAX_CONDITIONS:
            tried = []
            for c in options:
                own = labels([*rule, c], (0,))
                bad = sum(y == 0 for y in own)
                if c not in rule and bad and bad >= least * 2 / 3:
                    at = cuts[c[0]].index(c[1])
                    tried.append(((laplace(own), bad), c[0], at if c[2] else -at, c))
            if not tried or max(t[0] for t in tried) <= best:
                break
            best, _, _, c = max(tried, key=lambda t: t[:3])
            rule.append(c)
        while len(rule) > 1 and laplace(labels(rule[:-1], (2,))) >= laplace(labels(rule, (2,))):
            rule.pop()
        own = labels(rule, (0, 2))
        bad = sum(y == 0 for y in own)
        if not rule or bad < least or bad / max(1, len(own)) < qr.MIN_PRECISION or laplace(own) < qr.MIN_LAPLACE:
            break
        rules.append(rule)
        left = [r for r in left if not holds(rule, r[0])]
    return rules, holds


def test_op10(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    texts = dict(made_documents())
    got = {r.doc_id: r for r in run(spark, tables, "op10_decision_list")}
    assert {d: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for d, r in got.items()} == {d: brute_statistics(t) for d, t in texts.items()}
    features = qr.with_features(qr.base_statistics(docs)).select("doc_id", *qr.FEATURES, F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("f"))
    marked = features.join(labels, "doc_id")
    rows = [({n: r[n] for n in qr.FEATURES}, 2 if r.f == 2 else 0, r.quality) for r in marked.collect()]
    rules, holds = learned(rows, qr.thresholds(marked))
    assert rules
    values = {r.doc_id: {n: r[n] for n in qr.FEATURES} for r in features.collect()}
    for d, r in got.items():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and not any(holds(rule, values[d]) for rule in rules))
