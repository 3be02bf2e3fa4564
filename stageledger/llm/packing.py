"""Best-fit packing of tokenised documents by linear grouping.

Documents become pieces of at most ``CAPACITY`` tokens; a longer document's first
piece holds the remainder. The plan works on the histogram of piece lengths alone
(``CAPACITY`` entries at most, whatever the input):

1. lengths over ``SMALL`` are sorted falling and cut into ``GROUPS`` groups of equal
   cardinality (a length isn't divided); a group counts as its largest length left;
2. configurations of these few sizes are optimised, the largest size left with the
   subset of the others that fills the rest best (exact subset-sum bitsets);
3. actual lengths take the places of the rounded ones, for as many sequences at once
   as there are equal ones; the last place goes to the largest length that fits the
   room which is really left, so rounding costs nothing there;
4. small lengths fall best-fit into what room is left, then into new sequences.

A plan is a table of runs (length, first rank, count, first sequence, offset); a
piece finds its place by its rank among its length.

Defined cases: a null or empty text is its end id alone; null and repeated doc_ids
and repeated rows are packed as documents of their own; an empty table packs into
nothing; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ship, table
from .tokens import Encoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
SMALL = 256
GROUPS = 64

PIECES = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"
Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


def _cut(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary, "<u4"), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, uid, ids in zip(part.column("doc_id").to_pylist(), part.column("uid").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    for piece, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        for column, value in zip(rows, (doc, uid, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])), strict=True):
                            column.append(value)
                        at = stop
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    return rows.mapInArrow(_cut(vocabulary, end_id, capacity), PIECES)


class _Room:
    """Sequences by the room they have left, as runs of sequence numbers."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def put(self, room: int, first: int, count: int) -> None:
        if count and room > 0:
            if not self.runs[room]:
                insort(self.rooms, room)
            self.runs[room].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The run with the smallest room that is enough."""
        at = bisect_left(self.rooms, least)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.runs[room].pop()
        if not self.runs[room]:
            self.rooms.pop(at)
        return room, first, count


def _best_fit(items: list[tuple[int, int, int]], room: _Room, sequences: int, capacity: int, runs: list[Run]) -> int:
    """Put (length, first rank, count), falling, each into the tightest room; returns the sequences then used."""
    for length, rank, count in items:
        while count:
            found = room.take(length)
            if found is None:
                each = capacity // length
                found = (capacity, sequences, -(-count // each))
                sequences += found[2]
            left, first, have = found
            each = min(left // length, count)
            full = min(have, count // each)
            for k in range(each):  # the k-th item of each of the run's sequences
                runs.append((length, rank + k * full, full, first, capacity - left + k * length))
            room.put(left - each * length, first, full)
            room.put(left, first + full, have - full)
            rank, count = rank + each * full, count - each * full
    return sequences


def _best_rest(rest: int, sizes: list[int], left: list[int], start: int) -> list[int]:
    """Groups from ``start`` on (repeats allowed while left) whose sizes fill ``rest`` best."""
    reach, steps = 1, []
    mask = (1 << (rest + 1)) - 1
    for g in range(start, len(sizes)):
        for _ in range(min(left[g], rest // sizes[g])):
            grown = (reach | reach << sizes[g]) & mask
            if grown == reach:
                break
            steps.append((g, reach))
            reach = grown
    total, chosen = reach.bit_length() - 1, []
    for g, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(g)
            total -= sizes[g]
    return chosen


def _groups(large: list[tuple[int, int]], groups: int) -> list[list[int]]:
    """Lengths, falling, in groups of near equal cardinality."""
    each = max(1, -(-sum(c for _, c in large) // groups))
    members: list[list[int]] = [[]]
    have = 0
    for n, c in large:
        members[-1].append(n)
        have += c
        if have >= each:
            members.append([])
            have = 0
    return [m for m in members if m]


def _substitute(chosen: list[int], members: list[list[int]], left: dict[int, int], rising: list[int], capacity: int) -> dict[int, int]:
    """Actual lengths and their uses for a configuration of groups, and for the room that rounding left."""
    uses: dict[int, int] = {}
    rest = capacity

    def put(n: int) -> None:
        nonlocal rest
        uses[n] = uses.get(n, 0) + 1
        rest -= n

    def fitting() -> int | None:
        at = bisect_right(rising, rest) - 1
        while at >= 0 and left[rising[at]] <= uses.get(rising[at], 0):
            at -= 1
        return rising[at] if at >= 0 else None

    for g in chosen[: max(1, len(chosen) - 1)]:
        n = next((n for n in members[g] if left[n] > uses.get(n, 0)), None)
        if n is not None:
            put(n)
    while (n := fitting()) is not None:
        put(n)
    return uses


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int | None = GROUPS) -> tuple[int, list[Run]]:
    """(number of sequences, runs) for a histogram of lengths; ``groups`` None is plain best-fit, a bound for tests."""
    runs: list[Run] = []
    room = _Room()
    falling = sorted(((n, c) for n, c in histogram.items() if c), reverse=True)
    if groups is None:
        return _best_fit([(n, 0, c) for n, c in falling], room, 0, capacity, runs), runs
    left = {n: c for n, c in falling if n > small}
    rank = dict.fromkeys(left, 0)
    rising = sorted(left)
    members = _groups(list(left.items()), groups)
    sequences = 0
    while rising:
        members = [m for g in members if (m := [n for n in g if left[n]])]
        sizes, counts = [m[0] for m in members], [sum(left[n] for n in m) for m in members]
        counts[0] -= 1
        chosen = [0, *sorted(_best_rest(capacity - sizes[0], sizes, counts, 0))]
        uses = _substitute(chosen, members, left, rising, capacity)
        times = min(left[n] // k for n, k in uses.items())
        offset = 0
        for n in sorted(uses, reverse=True):
            for _ in range(uses[n]):
                runs.append((n, rank[n], times, sequences, offset))
                rank[n] += times
                offset += n
            left[n] -= times * uses[n]
            if not left[n]:
                rising.remove(n)
        room.put(capacity - offset, sequences, times)
        sequences += times
    return _best_fit([(n, 0, c) for n, c in falling if n <= small], room, sequences, capacity, runs), runs


def ranks(rows: DataFrame, total: int) -> DataFrame:
    """Rank of each piece among its length, 0 first.

    A common length is dealt to several buckets so that none ranks more than about
    total / 4096 rows; there are at most CAPACITY + 4096 buckets, whose first ranks
    are broadcast.
    """
    each = max(200, total // 4096)
    counts = rows.groupBy("length").agg(F.count("*").alias("n")).select("length", F.ceil(F.col("n") / each).alias("buckets"))
    dealt = rows.join(F.broadcast(counts), "length").withColumn("bucket", F.pmod(F.xxhash64("uid", "piece"), F.col("buckets")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("uid", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    return ranked.join(F.broadcast(bases), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("rank")).drop("bucket", "buckets", "base")


def _placed(keys: np.ndarray, first_rank: np.ndarray, sequence: np.ndarray, offset: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            batch = batch.drop_columns(["rank"])
            batch = batch.append_column("sequence_id", pa.array(sequence[at] + rank - first_rank[at], pa.int64()))
            yield batch.append_column("offset", pa.array(offset[at], pa.int64()))

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``rows`` is read several times: a written table."""
    spark = rows.sparkSession
    histogram = {x.length: x.n for x in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    _, runs = plan(histogram, capacity)
    runs.sort()
    table_ = np.array(runs or [(0, 0, 0, 0, 0)], dtype=np.int64)
    keys = (table_[:, 0] << 48) + table_[:, 1]
    schema = PIECES + ", sequence_id long, offset long"
    ship(spark)
    return ranks(rows, sum(histogram.values())).select(*[x.split()[0] for x in PIECES.split(", ")], "rank").mapInArrow(_placed(keys, table_[:, 1], table_[:, 3], table_[:, 4]), schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return pack(materialize(pieces(docs, vocabulary or vocabulary_path(VOCABULARY)), "pieces"))


def op7_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
