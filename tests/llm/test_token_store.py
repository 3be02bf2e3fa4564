import random
import zlib

import numpy as np
import pytest

from stageledger.llm import token_store as ts
from stageledger.llm.common import fresh_path
from stageledger.llm.tokens import Encoder, vocabulary_path

SAMPLES = ["It's a  test.\n\nNew, line..", "a.b,c", "don't, we'll. x_,y", " lead", "trail ", "\n", ".", "a .b", "x\n", "é, É.", "日本 語, す。a", "WORD!!", "x*** y###", "1,000.5", "<|endoftext|>", "a b", "İ ı", "a\tb", ""]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    e = Encoder.of(vocabulary_path(name))
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "B", "é", " ", " ", ",", ".", "\n", "'s", "9", "#", "  "]) for _ in range(40)) for _ in range(800)]
    for text in SAMPLES + made:
        assert e.encode([text]) == e.whole([text]), text


def test_memo_starts_anew(monkeypatch):
    from stageledger.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_LIMIT", 3)
    e = Encoder(vocabulary_path("word_bpe_49k.json"))
    for i in range(20):
        text = f"some words {'ab' * (i + 1)} more"
        assert e.encode([text]) == e.whole([text])


def test_crc_parts_combine():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 50))), rng.bytes(int(rng.integers(0, 5000)))
        left = ts.shift_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
        assert int(left) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_cuts():
    ids = np.random.default_rng(2).integers(0, 49408, 20_000)
    ends = ts.cut_points(ts.marks(ids).tolist(), len(ids))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= ts.MAX_CHUNK and sizes[:-1].min() >= ts.MIN_CHUNK
    moved = ts.cut_points(ts.marks(np.concatenate((ids[:7], ids))).tolist(), len(ids) + 7)
    assert len({e + 7 for e in ends} & set(moved)) > len(ends) // 2


def brute(rows):
    e = Encoder.of(vocabulary_path(ts.VOCABULARY))
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*np.frombuffer(e.whole([text or ""])[0], "<u4"), 1] if text else [1]
        out.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


def test_store_round_trip(spark, odd, none):
    root = fresh_path(spark, "t")
    ts.write_store(odd, root, vocabulary_path(ts.VOCABULARY))
    got = ts.read_digests(spark, root).collect()
    expected, total = brute([(r.doc_id, r.text) for r in odd.collect()])
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted(expected, key=key)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()
    packs = spark.read.parquet(f"{root}/packs").where("payload is not null")
    assert packs.count() == packs.select("hash").distinct().count()
    ids = {(r.doc_id, len(r.ids)) for r in ts.read_ids(spark, root).collect()}
    assert ids == {(r.doc_id, r.n_tokens) for r in got}
    assert len(ts.store_root(spark, root)) == 32
    root = fresh_path(spark, "t")
    ts.write_store(none, root, vocabulary_path(ts.VOCABULARY))
    assert ts.read_digests(spark, root).count() == 0


def test_altered_chunk_is_noticed(spark, odd):
    root = fresh_path(spark, "t")
    ts.write_store(odd, root, vocabulary_path(ts.VOCABULARY))
    bad = fresh_path(spark, "t")
    spark.read.parquet(f"{root}/packs").selectExpr("doc_id", "uid", "seq", "hash", "n", "case when payload is not null then cast('zzzz' as binary) end payload").write.parquet(f"{bad}/packs")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{root}/{name}").write.parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match="address"):
        ts.read_digests(spark, bad).count()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_a_fresh_tokenizer(name, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    fresh = Tokenizer.from_file(vocabulary_path(name))
    ids = lambda t, text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    marked = ["one <|endoftext|> two", "<|endoftext|>", "a.<|endoftext|>b, c", "x<|startoftext|><|ENDOFTEXT|>", "it <| ends |>"]
    for text in SAMPLES + marked:
        assert Encoder.of(vocabulary_path(name)).encode([text]) == [ids(fresh, text)], text
    fresh.add_special_tokens([AddedToken("[PAD]", special=True)])
    fresh.add_tokens(["two words", "stop.stop"])
    path = str(tmp_path / "more.json")
    fresh.save(path)
    fresh = Tokenizer.from_file(path)
    for text in [*marked, "a [PAD] b", "some two words here", "full stop.stop x", "two  words"]:
        assert Encoder(path).encode([text]) == [ids(fresh, text)], text


def altered(spark, root, **changes):
    """A copy of the store with some tables changed by a function of the frame."""
    bad = fresh_path(spark, "t")
    for name in ("packs", "recipes", "manifest"):
        changes.get(name, lambda f: f)(spark.read.parquet(f"{root}/{name}")).coalesce(1).write.parquet(f"{bad}/{name}")
    return bad


def test_losses_and_alterations_fail(spark, odd):
    from pyspark.sql import functions as F

    root = fresh_path(spark, "t")
    rows = [(i, " ".join(f"word{(i * 7 + j) % 900} of{j}" for j in range(i % 5 * 90))) for i in range(60)]
    ts.write_store(odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")), root, vocabulary_path(ts.VOCABULARY))
    whole = altered(spark, root)
    n = ts.read_digests(spark, whole, expected=ts.store_root(spark, root)).count()
    assert n == 60 + odd.count()
    some = spark.read.parquet(f"{root}/packs").where("payload is not null").orderBy("hash").first()
    one = spark.read.parquet(f"{root}/recipes").where("doc_id = 44").first()
    last = spark.read.parquet(f"{root}/manifest").agg(F.max("part")).first()[0]
    swap = F.when(F.col("doc_id") == 43, 44).when(F.col("doc_id") == 44, 43).otherwise(F.col("doc_id"))
    bad = {
        "a chunk is missing": {"packs": lambda f: f.where(F.col("payload").isNull() | (F.col("hash") != some.hash))},
        "missing or out of place|match part": {"recipes": lambda f: f.where(F.col("uid") != one.uid)},
        "match its leaf": {"recipes": lambda f: f.withColumn("doc_id", swap)},
        "match part": {"recipes": lambda f: f.where(F.col("part") != last)},
        "doesn't match part": {"manifest": lambda f: f.withColumn("n_tokens", F.col("n_tokens") + 1)},
        "the manifest doesn't match": {"manifest": lambda f: f.where(F.col("part") != last)},
    }
    for match, change in bad.items():
        with pytest.raises(Exception, match=match):
            ts.read_digests(spark, altered(spark, root, **change)).collect()
    lost = altered(spark, root, packs=lambda f: f.where("payload is null"))
    with pytest.raises(Exception, match="a chunk is missing"):
        ts.read_ids(spark, lost).collect()
    with pytest.raises(ValueError, match="root"):
        ts.read_digests(spark, root, expected=b"other")
