import re
from collections import Counter

from pyspark.sql import functions as F

from stageledger.llm import quality_classifier as qc
from stageledger.llm import quality_rules as qr


def brute_statistics(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in qr.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, odd, none):
    more = ["a b a b a b c", "x\nx\n\nx", "#a &b", "a b c\na b c", "é é é é", "w " * 60 + "a b c"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.base_statistics(docs).collect())
    assert got == Counter((d, *brute_statistics(t)) for d, t in texts)
    assert qr.base_statistics(none).count() == 0


def test_statistics_of_long_texts(spark, odd, monkeypatch):
    """Counted from pieces: words, lines and windows that pieces cut, blank pieces, copies."""
    texts = ["w" * 90 + " a b c a b c", " " * 70 + "a b" + "\n" * 70 + "a b c\na b c", "é ñ\x0bÜ! " * 40, "a\tb\r\n" * 30 + "a b", "no repeats #here? & " + " ".join(map(str, range(60))), "\U0001f600 x " * 30, " \n" * 60]
    extra = spark.createDataFrame([(900 + i % 5, t) for i, t in enumerate([*texts, *texts[:2]])] + [(None, texts[3])], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_dup_lines", "n_repeat_words", "text"]
    rows = lambda: Counter(tuple(r) for r in qr.base_statistics(docs, "text").select(*names).collect())
    whole = rows()
    made, windows = [], qr._long_statistics
    monkeypatch.setattr(qr, "_long_statistics", lambda pieces: made.append(pieces.count()) or windows(pieces))
    for piece in (7, 40):
        monkeypatch.setattr(qr, "LONG", 50)
        monkeypatch.setattr(qr, "LONG_PIECE", piece)
        assert rows() == whole
    assert made[0] > made[1] > 100


def labelled(spark):
    good = [(i, f"Word{i % 7} " + " ".join(f"alpha{(i * 7 + j) % 53} beta{j}" for j in range(40)) + ".") for i in range(300)]
    junk = [(300 + i, " ".join(f"gam{(i * 3 + j) % 31}*** del{j}###" for j in range(40))) for i in range(150)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 300, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    return docs, labels


def test_decision_list(spark, none):
    docs, labels = labelled(spark)
    rules = qr.fit(qr.base_statistics(docs), labels)
    assert rules and all(r.precision >= qr.MIN_PRECISION for r in rules)
    got = {r.doc_id: r.kept for r in qr.classify(qr.base_statistics(docs), rules).collect()}
    assert got == {i: i < 300 for i in got}
    assert qr.fit(qr.base_statistics(docs), labels.where("quality > 5")) == []
    assert qr.classify(qr.base_statistics(none), rules).count() == 0


def test_classifier(spark, odd, none):
    docs, labels = labelled(spark)
    model = qc.fit(docs, labels)
    got = {r.doc_id: r.score for r in qc.score(docs, model, "doc_id").collect()}
    assert all((s >= 0.5) == (i < 300) for i, s in got.items())
    # All rows count, and the blocked products are exact: against one plain vote.
    texts = dict(map(tuple, docs.collect()))
    for i in list(got)[:20]:
        own = model.latent(*qc.term_counts(texts[i]))
        near = sorted(zip((model.vectors @ own).tolist(), model.labels.tolist(), strict=True), reverse=True)[: qc.NEIGHBOURS]
        weights = [max(c, 0) ** qc.SHARPNESS for c, _ in near]
        assert abs(got[i] - sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)) < 1e-4
    kept = qc.score(odd, model, *odd.columns, name="_q")
    assert kept.columns == [*odd.columns, "_q"] and kept.count() == odd.count()
    assert all(0 <= r._q <= 1 for r in kept.collect())
    assert qc.score(none, model, "doc_id").count() == 0
    assert qc.fit(docs, labels.limit(0)).prior == 1.0


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = qc.fit(docs, labels), qc.fit(docs, flipped)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()
