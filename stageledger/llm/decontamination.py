"""Benchmark decontamination: pigeonhole edit matching.

Texts are lower-cased and their white space joined to single spaces. An item of m
characters may differ from a passage by k = m * ERROR_PERCENT // 100 edits. It is
split into k + 1 pieces of near equal length; a passage within k edits holds at
least one piece untouched, so an automaton finds exact piece hits in every whole
text, and around each hit the item is verified by Myers' bit-parallel distance.

The benchmark is a stated query set: it is read in blocks of at most
``BLOCK_CHARS`` characters, each sent to the executors once and held against all
documents, however many blocks there are.

Defined cases: null and empty texts match nothing; items without words are no
items; items with equal text are one search reported under each id; a document that
holds an item several times has one row, with the least distance, then the first
place; repeated documents have rows of their own; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

ERROR_PERCENT = 5
BLOCK_CHARS = 4_000_000

HITS = "doc_id long, item_id long, distance int, start long, stop long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, percent: int = ERROR_PERCENT) -> int:
    return len(item) * percent // 100


def split_pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of near equal length."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        found[c] |= 1 << i
    return dict(found)


def myers(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``text`` that is within k edits of the item.

    Ends are exclusive; of equal distances the first end counts.
    """
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # the text before the match is free
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, at + 1)
            if not score:
                break
    return best


class Matcher:
    """Items of one block, ready to be held against texts."""

    def __init__(self, items: list[tuple[int, str]], percent: int = ERROR_PERCENT):
        import ahocorasick

        ids: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            ids[normal(text)].append(item_id)
        ids.pop("", None)
        self.items = [(text, sorted(own), budget(text, percent), masks(text), masks(text[::-1])) for text, own in ids.items()]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (text, _, k, _, _) in enumerate(self.items):
            for offset, piece in split_pieces(text, k):
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.ready = bool(places)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) in the normalised text."""
        if not self.ready or not text:
            return []
        own = normal(text)
        windows: dict[int, list[int]] = defaultdict(list)
        for end, (length, found) in self.automaton.iter(own):
            for i, offset in found:
                windows[i].append(end + 1 - length - offset)
        out = []
        for i, starts in windows.items():
            item, ids, k, peq, back = self.items[i]
            at = own.find(item)
            if at >= 0:
                out.extend((x, 0, at, at + len(item)) for x in ids)
                continue
            best = None
            for lo, hi in _joined(sorted(set(starts)), k):
                lo, stop = max(0, lo - k), hi + len(item) + k
                found = myers(peq, len(item), own[lo:stop], k)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1])
            if best:
                first = max(0, best[1] - len(item) - k)
                back_found = myers(back, len(item), own[first : best[1]][::-1], best[0])
                start = best[1] - back_found[1] if back_found else first
                out.extend((x, best[0], start, best[1]) for x in ids)
        return out


def _joined(starts: list[int], k: int) -> list[tuple[int, int]]:
    """Starts whose windows overlap in error are verified as one run."""
    runs: list[tuple[int, int]] = []
    for s in starts:
        if runs and s - runs[-1][1] <= 2 * k + 1:
            runs[-1] = (runs[-1][0], s)
        else:
            runs.append((s, s))
    return runs


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The query set, a bounded block at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    own: list[tuple[int, str]] = []
    size = 0
    for x in rows.orderBy("item_id", "text").toLocalIterator():
        if own and size + len(x.text) > BLOCK_CHARS:
            yield own
            own, size = [], 0
        own.append((x.item_id, x.text))
        size += len(x.text)
    if own:
        yield own


_READY: dict[int, Matcher] = {}


def _matcher(sent, percent: int) -> Matcher:
    """Built once per worker and block."""
    if sent.id not in _READY:
        _READY.clear()
        _READY[sent.id] = Matcher(sent.items, percent)
    return _READY[sent.id]


class _Sent:
    def __init__(self, at: int, items: list[tuple[int, str]]):
        self.id, self.items = at, items


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """doc_id, item_id, distance, start, stop (in the normalised text) of every leak."""
    import uuid

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(_Sent(uuid.uuid4().int, items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, percent)
            for batch in batches:
                found = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in matcher.find(t)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "stop"])

        hits = rows.mapInArrow(run, HITS)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], HITS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """Rows of ``docs`` in whose text no item is found, with all their columns, in one pass per block."""
    spark = docs.sparkSession
    ship(spark)
    import uuid

    kinds = docs.schema
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(_Sent(uuid.uuid4().int, items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, percent)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, kinds)
    return docs


def op5_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
