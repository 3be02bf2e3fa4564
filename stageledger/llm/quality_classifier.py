"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms of a text are its words (hashed), its words' shapes (hashed) and counts of
repetition. A bounded, documented sample of labelled rows (``SAMPLE`` with the
smallest hashes of doc_id, from rows that are not held out) fixes term weights and,
by a truncated SVD, the latent space. The sample's vectors (``SAMPLE`` x ``RANK``
floats) and the projection (``TERMS`` x ``RANK``) are broadcast: 3 MB at any input
size. Every document's cosines with all of them come from blocked products, and its
``NEIGHBOURS`` nearest vote with weights that rise with similarity.

Defined cases: a null or empty text has no direction and scores the sample's mean
label, as does every text where no label can be learned from (then 1); a null
doc_id is not held out; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

SAMPLE = 4096
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 512
WORD_TERMS, SHAPE_TERMS = 4096, 1024
TERMS = WORD_TERMS + SHAPE_TERMS + 4
MEMO_LIMIT = 200_000

_SIGNS = ".,!?#*$%&|<>()[]{}\"';:-+=_/\\~^@"
_MEMO: dict[str, int] = {}
_SHAPES: dict[str, int] = {}


def _terms(word: str) -> int:
    """The word's own term, and 65536 times that of its shape: case, letters or digits, signs after it."""
    low = word.lower()
    core = low.strip(_SIGNS)
    tail = low[low.find(core) + len(core) :]
    case = "A" if len(core) > 1 and word.isupper() else "T" if word[:1].isupper() else "-"
    shape = case + ("a" if core.isalpha() else "9" if core.isdigit() else "m" if core else "s") + tail[:1] + "+" * (len(tail) > 1)
    at = _SHAPES.get(shape)
    if at is None:
        at = _SHAPES[shape] = WORD_TERMS + zlib.crc32(shape.encode()) % SHAPE_TERMS
    return zlib.crc32(core.encode()) % WORD_TERMS + (at << 16)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a whole text and how often each occurs."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = set(words).difference(_MEMO)
    if len(_MEMO) + len(new) > MEMO_LIMIT:
        _MEMO.clear()
        new = set(words)
    _MEMO.update((w, _terms(w)) for w in new)
    packed = np.array(list(map(_MEMO.__getitem__, words)), dtype=np.int64)
    found = np.concatenate((packed & 0xFFFF, packed >> 16))
    windows = max(0, len(words) - 2)
    lines = [x for x in text.split("\n") if x.strip()]
    base = WORD_TERMS + SHAPE_TERMS
    extra = [(base, sum(map(eq, words, words[1:]))), (base + 1, windows - len(set(zip(words, words[1:], words[2:], strict=False)))), (base + 2, len(lines) - len(set(lines))), (base + 3, len(words) - len(set(words)))]
    counts = np.bincount(found, minlength=TERMS)
    for term, n in extra:
        counts[term] = n
    at = np.flatnonzero(counts)
    return at, counts[at]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    projection: np.ndarray  # TERMS x RANK, term weights in it
    vectors: np.ndarray  # SAMPLE x RANK, of length 1
    labels: np.ndarray
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), BLOCK):
            own = np.stack([self.latent(*term_counts(t)) for t in texts[lo : lo + BLOCK]])
            out[lo : lo + len(own)] = self.vote(own)
        return out

    def latent(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) @ self.projection[terms]
        length = float(np.linalg.norm(v))
        return v / length if length > 0 else v

    def vote(self, own: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(own), self.prior)
        cosines = own @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weights.sum(axis=1)
        votes = (weights * self.labels[near]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([x.tolist() for x, _ in found], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in found], pa.list_(pa.int32()))], names=["doc_id", "quality", "terms", "counts"]
        )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Latent space and labelled vectors from the bounded sample; its texts stay on the executors."""
    ship(docs.sparkSession)
    usable = labels.where("quality in (0, 1)").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null").distinct()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # SAMPLE rows
    rows = texts.select("doc_id", "quality", "text").mapInArrow(_sparse, "doc_id long, quality int, terms array<int>, counts array<int>")
    found = sorted(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE).collect(), key=lambda x: (x.doc_id, x.quality, x.terms))
    return _fit(found)


def _fit(found: list) -> Model:
    labels = np.array([x.quality for x in found], dtype=np.float64)
    prior = float(labels.mean()) if len(labels) else 1.0
    matrix = np.zeros((len(found), TERMS), dtype=np.float32)
    for i, x in enumerate(found):
        matrix[i, x.terms] = np.log1p(np.array(x.counts, dtype=np.float32))
    if not matrix.any():
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.empty(0), prior)
    df = (matrix > 0).sum(axis=0)
    idf = np.log((1 + len(found)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    matrix *= idf
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix /= np.where(lengths > 0, lengths, 1)
    # Randomised range finder with power steps: the leading right singular vectors.
    rank = min(RANK, len(found), TERMS)
    random = np.random.default_rng(7).standard_normal((TERMS, rank + 16)).astype(np.float32)
    basis = matrix @ random
    for _ in range(3):
        basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
    _, _, right = np.linalg.svd(np.linalg.qr(basis)[0].T @ matrix, full_matrices=False)
    space = right[:rank].T
    vectors = matrix @ space
    sizes = np.linalg.norm(vectors, axis=1)
    there = sizes > 0
    return Model(np.ascontiguousarray(idf[:, None] * space, dtype=np.float32), np.ascontiguousarray(vectors[there] / sizes[there, None], dtype=np.float32), labels[there], prior)


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every row, as ``name``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(sent.value.scores(batch.column("text").to_pylist()), pa.float64())
            yield batch.append_column(name, found).select([*keep, name])

    own = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", `{name}` double")


def op8_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
