import os

import pytest

import corpus_pipeline
from stageledger.llm import decontamination, quality_classifier, quality_rules
from stageledger.llm.common import materialize, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    texts = {r.doc_id: r.text for r in rows}
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
        out.append(docs)
    assert all(d.columns == list(rows[0].asDict()) for d in out[:-1])
    kept = [{r.doc_id for r in d.select("doc_id").collect()} for d in out]
    assert all(a >= b for a, b in zip([set(texts), *kept], kept, strict=False))
    # Each stage against brute force on its own input.
    labels = table(spark, SF, "labels")
    model = quality_classifier.fit(table(spark, SF, "documents"), labels)
    scores = model.scores(list(texts.values()))
    assert kept[0] == {d for d, s in zip(texts, scores, strict=True) if s >= 0.5}
    from test_jaccard import brute

    parts = brute([(d, texts[d]) for d in sorted(kept[1])], 5, (4, 5))
    assert kept[2] == {d for d in kept[1] if parts[d] == d}
    items = [decontamination.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    assert not [d for d in kept[3] if any(x in decontamination.normal(texts[d]) for x in items)]
    assert kept[4] == kept[3]


def test_odd_rows_pass(spark, odd, none):
    for docs in (odd, none):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns, name
            assert got.count() <= n, name


def test_names_that_clash(spark):
    names = ["_quality", "_Quality_", "_row", "_s", "_t", "_w", "_h", "kept", "t", "v", "first", "uid", "n_words", "base_failed", "symbol_share", "score"]
    docs = table(spark, SF, "documents").limit(40).selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert all(r[n] == n for r in got.collect() for n in names), name


def test_rules_are_learned_from_rows_that_the_classifier_took_away(spark, monkeypatch):
    docs, learned, fit = table(spark, SF, "documents"), [], quality_rules.fit
    monkeypatch.setattr(quality_rules, "fit", lambda *a: learned.append(fit(*a)) or learned[-1])
    good = docs.join(table(spark, SF, "labels").where("quality = 1"), "doc_id", "left_semi")
    kept = {r.doc_id for r in corpus_pipeline.rules(spark, good, SF).select("doc_id").collect()}
    assert learned[0] and kept
    base = quality_rules.base_statistics(good).where(~quality_rules.base_failed())
    gone = {r.doc_id for r in base.select("doc_id").collect()} - kept
    assert len(gone) <= 0.02 * good.count()
