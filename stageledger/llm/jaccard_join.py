"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Sets link when 20 |A n B| >= 17 |A u B| (a similarity of 0.85 here; the pipeline's
0.8 is 4 / 5), that is, when their Hamming distance is at most a share of their
joint size. Sets are put into size bands; a band's instance holds its own sets and
the smaller ones that can still link with them, so two linked sets meet in the
instance of the larger one, where their distance is at most some k.

The scheme has two levels at every k. The domain is hashed into k // 2 + 1 groups, so
that one group at least has at most one of the k differences, and each group into
three partitions; the three pairs of a group's partitions are signatures, and one
difference leaves one pair untouched. A set that differs from any partner in h
elements at most keeps only the ``touched`` + 1 pairs with the most elements (ties by
their place): so many that one is untouched. Of two linked sets, such a pair is kept
by the one whose least kept pair is the larger, and as it is the same in both, the
other keeps it too. Weak signatures go, no link does.

Equal sets are one vertex. Signatures with two vertices or more are buckets; all
members are verified against the bucket's least vertex, the links are closed to
components, and only then are members of one bucket that are still in different
components paired and verified. Links between different sets that are already
connected need no check, so thousands of near copies cost a star each, not a square.

What is known of a bucket, a vertex or a hub is an aggregate with map-side sums,
written and joined back, never a window: a signature or a text that a third of all
rows share is a skewed join key, which AQE splits.

Defined cases: null, empty and wordless texts have no shingles and stand alone; rows
of one doc_id count as one document with several texts; a null doc_id takes part
through its text, and alone has a null component; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, ship, table

SHINGLE = 4
#: Link when NUMERATOR * union <= DENOMINATOR * intersection.
THRESHOLD = (17, 20)
#: A band's largest size is so many times its least; few sets are then in two instances.
BAND = 2
SLICE_BYTES = 1 << 20
#: Rows of a batch that are turned into Python's texts at once.
PIECE = 256
#: Slices of the signatures' domain, shuffled one after the other: what a slice shuffles is gone before the next one's.
SLICES = 2
#: Rounds of stars about other centres before the members still apart are paired.
STAR_ROUNDS = 1
#: Larger buckets aren't paired row by row: their vertices meet in blocks.
SMALL_BUCKET = 32
#: Vertices and shingles that a block holds, about.
BLOCK_ROWS, BLOCK_SHINGLES = 400, 400_000

_U = np.uint64
_WORD, _WORD_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_PLACE = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for base in (_WORD, _WORD_INVERSE):
        powers = np.full(n, base, dtype=_U)
        powers[0] = 1
        found.append(np.cumprod(powers, dtype=_U))
    return found[0], found[1]


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text; A-Z count as a-z."""
    pending: list[bytes] = []
    total = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if pending and total + len(data) > SLICE_BYTES:
            yield from _slice_sets(pending, size)
            pending, total = [], 0
        pending.append(data)
        total += len(data) + 1
    if pending:
        yield from _slice_sets(pending, size)


def _segments(data: bytes) -> Iterator[bytes]:
    """A long run of bytes cut before white space, about every SLICE_BYTES."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        found = _SPACES.search(data, at + SLICE_BYTES)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word; the temporary arrays are those of one segment."""
    words, starts, base = [], [], 0
    for part in _segments(data):
        codes = np.frombuffer(part + b"\n", dtype=np.uint8)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        start, stop = edge[::2], edge[1::2]
        low = codes + ((codes >= 65) & (codes <= 90)).astype(np.uint8) * np.uint8(32)
        # Powers are kept for segments of the usual size only.
        up, down = (_powers if len(codes) <= 2 * SLICE_BYTES else _powers.__wrapped__)(max(len(codes) + 1, 2 * SLICE_BYTES))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(low.astype(_U) * up[: len(codes)], dtype=_U)))
        words.append(_mix((sums[stop] - sums[start]) * down[start]))
        starts.append(start + base)
        base += len(part)
    return np.concatenate(words), np.concatenate(starts)


def _slice_sets(rows: list[bytes], size: int) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(r) + 1 for r in rows])
    words, start = _word_hashes(b"\n".join(rows))
    n = len(words)
    if n >= size:
        grams = words[: n - size + 1] * _PLACE[0]
        for i in range(1, size):
            grams = grams + words[i : n - size + 1 + i] * _PLACE[i]
        grams = _mix(grams)
    first = np.searchsorted(start, np.concatenate((np.zeros(1, np.int64), ends)))
    for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
        if hi - lo >= size:
            yield np.unique(grams[lo : hi - size + 1])
        elif hi > lo:  # the whole sequence as one
            own = words[lo:hi]
            yield _mix((own * np.array(_PLACE[: hi - lo], dtype=_U)).sum(dtype=_U, keepdims=True) + _U(hi - lo))
        else:
            yield np.empty(0, _U)


def set_id(grams: np.ndarray) -> int:
    """One signed 64-bit id of a set, whatever its order."""
    found = _mix(_mix(grams * _PLACE[5]).sum(dtype=_U, keepdims=True) + _U(len(grams)))
    return int(found.view(np.int64)[0])


def farthest(total: int, threshold: tuple[int, int]) -> int:
    """Largest Hamming distance of linked sets whose sizes sum to ``total``."""
    num, den = threshold
    return (den - num) * total // (den + num)


@lru_cache(maxsize=65536)
def instances(n: int, threshold: tuple[int, int]) -> tuple[tuple[int, int, int], ...]:
    """(instance, its k, this size's own bound) of each instance that a set of n elements is in."""
    num, den = threshold
    found, i, low = [], 0, 1
    while num * low <= den * n:
        high = BAND * low
        if n <= high:
            found.append((i, farthest(2 * high, threshold), farthest(n + min(high, den * n // num), threshold)))
        i, low = i + 1, high + 1
    return tuple(found)


def touched(differences: int, groups: int) -> int:
    """Pairs that so many differences touch at most: two pairs each alone in a group, one more as a group's second."""
    return min(2 * differences, differences + groups)


def signatures(grams: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """All PartEnum signatures of one set, as unsigned 64-bit hashes; none where only equal sets link."""
    out = []
    spread = _mix(grams * _PLACE[6])
    for instance, k, own in instances(len(grams), threshold):
        if not own:
            continue
        salt = _U((instance + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        groups = k // 2 + 1
        at = ((_mix(grams ^ salt) >> _U(32)) * _U(3 * groups) >> _U(32)).astype(np.int64)
        sums = np.zeros(3 * groups, dtype=_U)
        np.add.at(sums, at, spread)
        sums, counts = sums.reshape(groups, 3), np.bincount(at, minlength=3 * groups).reshape(groups, 3)
        i, j = [0, 0, 1], [1, 2, 2]
        number = np.arange(3 * groups, dtype=_U).reshape(groups, 3)
        pairs = _mix(_mix(sums[:, i] ^ salt) + sums[:, j] * _PLACE[4] + number).ravel()
        order = (counts[:, i] + counts[:, j]).ravel() * len(pairs) + np.arange(len(pairs))
        keep = touched(own, groups) + 1
        out.append(pairs[np.argpartition(order, -keep)[-keep:]] if keep < len(pairs) else pairs)
    return np.unique(np.concatenate(out)) if out else np.empty(0, _U)


def linked(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> bool:
    num, den = threshold
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return den * both >= num * (len(a) + len(b) - both)


def _set_rows(size: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            n, ids, own = [], [], []
            for grams in shingle_sets(part.column("text").to_pylist(), size):
                n.append(len(grams))
                ids.append(set_id(grams) if len(grams) else None)
                own.append(signatures(grams, threshold).view(np.int64))
            ends = np.concatenate((np.zeros(1, np.int32), np.cumsum([len(x) for x in own]))).astype(np.int32)
            sigs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), sigs], names=["doc_id", "t", "n_shingles", "v", "sigs"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few rows: only a piece's texts are held twice, in Arrow's form and in Python's."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PIECE):
            yield batch.slice(lo, PIECE)


def _check(size: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = ("", np.empty(0, _U))
        for part in _pieces(batches):
            keep = []
            others = shingle_sets(part.column("text_b").to_pylist(), size)
            for text, b in zip(part.column("text_a").to_pylist(), others, strict=True):
                if text != last[0]:
                    last = (text, next(shingle_sets([text], size)))
                keep.append(linked(last[1], b, threshold))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts link; ``texts`` has one (v, text) per vertex."""
    right = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_check(size, threshold), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b) but the roots: the least vertex of its component.

    Large-star and small-star rounds, until every vertex has one link, to a vertex
    that has none. Each step is a written table, so that a hub is a skewed join key,
    which AQE splits. ``links`` must be a written table; it is kept.
    """
    edges = links
    while True:
        rising = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        both = rising.unionByName(rising.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = rising.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        # Each vertex now has only lesser neighbours.
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
        small = materialize(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), "small-star")
        for x in (least, large, down):
            discard(x)
        if edges is not links:
            discard(edges)
        edges = small
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def text_key(text: str = "text") -> Column:
    """What a row's text is known by where its doc_id doesn't tell rows apart."""
    return F.xxhash64(text)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    return labelled(docs, size, threshold).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, t (``text_key``), n_shingles, component_id of every row, and ``first``: whether the
    row is its component's first, by least doc_id, null ids last, and by text; rows without shingles are."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("t"), "text")
    signed = materialize(docs.mapInArrow(_set_rows(size, threshold), "doc_id long, t long, n_shingles long, v long, sigs array<long>"), "signed")
    # Equal sets meet first, one row for each vertex; then signatures.
    vertices = materialize(signed.where("v is not null").select("v", "sigs").dropDuplicates(["v"]), "vertices")
    rows = materialize(signed.drop("sigs"), "sets")
    discard(signed)
    members = rows.where("v is not null")
    slices = [_buckets(vertices, k) for k in range(SLICES)]
    discard(vertices)
    buckets = reduce(DataFrame.unionByName, slices)
    centres = materialize(buckets.groupBy("sig").agg(F.min("v").alias("a")), "centres")
    stars = materialize(buckets.join(centres, "sig").where("v > a").select("a", F.col("v").alias("b")).distinct(), "stars")
    discard(centres)
    # One text, and the size, of each vertex in a bucket.
    once = members.groupBy("v").agg(_first(), F.first("n_shingles").alias("n"))
    holders = materialize(once.join(buckets.select("v").distinct(), "v", "left_semi").select("v", "first.doc_id", "first.t", "n"), "holders")
    texts = materialize(_texts(docs, holders, size), "texts", compression="zstd")
    links = materialize(verify(stars, texts, size, threshold), "links")
    roots = components(links)
    label = lambda frame: frame.join(roots.withColumnRenamed("v", "_v"), frame["v"] == F.col("_v"), "left").withColumn("root", F.coalesce("root", "v")).drop("_v")
    num, den = threshold
    apart = materialize(buckets.select("sig", "v").join(holders.select("v", "n"), "v"), "apart")
    done = stars
    for turn in range(STAR_ROUNDS + 1):
        # Members of one bucket that are still in different components.
        rooted = materialize(label(apart), "rooted")
        centre = F.min(F.struct(F.xxhash64("v", F.lit(turn)), F.col("v").alias("yv"), F.col("n").alias("yn"), F.col("root").alias("yr")))
        found = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), centre.alias("hub"))
        mixed = materialize(found.where("lo < hi").select("sig", "size", "hub"), "mixed")
        if mixed.isEmpty():  # each bucket is within one component
            for x in (rooted, mixed):
                discard(x)
            break
        split = materialize(rooted.join(mixed, "sig").select("sig", "v", "n", "root", "size", "hub"), "apart")
        for x in (apart, rooted, mixed):
            discard(x)
        apart = split.select("sig", "v", "n")
        apart._stageledger_path = split._stageledger_path
        if turn < STAR_ROUNDS:  # against another centre each time
            pairs = split.select(F.col("v").alias("xv"), F.col("n").alias("xn"), F.col("root").alias("xr"), "hub.yv", "hub.yn", "hub.yr")
        else:  # all that is left: small buckets as pairs, large ones in blocks
            sized = split
            few = sized.where(F.col("size") <= SMALL_BUCKET)
            other = few.select("sig", F.col("v").alias("yv"), F.col("n").alias("yn"), F.col("root").alias("yr"))
            pairs = few.select("sig", F.col("v").alias("xv"), F.col("n").alias("xn"), F.col("root").alias("xr")).join(other, "sig").where("xv < yv")
            large = sized.where(F.col("size") > SMALL_BUCKET)
            blocked = None if large.isEmpty() else _blocked_links(large, texts, size, threshold)
        near = (F.col("xn") * num <= F.col("yn") * den) & (F.col("yn") * num <= F.col("xn") * den)
        pairs = pairs.where((F.col("xr") != F.col("yr")) & near).select(F.least("xv", "yv").alias("a"), F.greatest("xv", "yv").alias("b")).distinct()
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        found = verify(pairs, texts, size, threshold)
        found = materialize(found.unionByName(blocked) if turn == STAR_ROUNDS and blocked is not None else found, "links")
        done = done.unionByName(pairs)
        if not found.isEmpty():
            # What is connected already counts as stars.
            links = materialize(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(found), "links")
            roots = components(links)
    rooted = label(rows.select("doc_id", "t", "n_shingles", "v"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.where("root is not null").groupBy("root").agg(_first()).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.t").alias("_t")), "least")
    first = F.col("root").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("t") == F.col("_t"))
    for x in (rows, *slices, stars, holders, texts, links, apart):
        discard(x)
    return rooted.join(least, "root", "left").select("doc_id", "t", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), first.alias("first"))


def _buckets(vertices: DataFrame, k: int) -> DataFrame:
    """(sig, v) of the signatures in the k-th slice that two vertices or more have."""
    signed = vertices.select(F.explode("sigs").alias("sig"), "v").where(F.pmod("sig", F.lit(SLICES)) == k)
    shared = materialize(signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig"), "shared")
    # Not broadcast unless Spark finds it small; else built in parts, a part for each partition of the join.
    out = materialize(signed.join(shared.hint("shuffle_hash"), "sig").select("sig", "v"), "buckets")
    discard(shared)
    return out


def _blocked_links(rows: DataFrame, texts: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) among the vertices of large buckets (sig, v, n, root), enough to connect them.

    Vertices that large buckets connect form a cluster. Its members of the commonest
    root are never held against each other, only against the rest, block by block.
    """
    first = materialize(rows.groupBy("sig").agg(F.min("v").alias("a")), "centres")
    edges = materialize(rows.join(first, "sig").select("a", F.col("v").alias("b")).where("a <> b").distinct(), "cluster-edges")
    discard(first)
    cluster = components(edges).select("v", F.col("root").alias("c"))
    cluster = cluster.unionByName(cluster.select(F.col("c").alias("v"), "c").distinct())
    own = materialize(rows.select("v", "n", "root").distinct().join(cluster, "v"), "clusters")
    discard(edges)
    by_root = own.groupBy("c", "root").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    blocks = lambda m, shingles: F.ceil(F.greatest(m / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("int")
    main = by_root.groupBy("c").agg(
        F.max(F.struct("m", "root", "shingles")).alias("top"), F.sum("m").alias("m"), F.sum("shingles").alias("shingles")
    ).select("c", F.col("top.root").alias("top"), blocks(F.col("top.m"), F.col("top.shingles")).alias("nt"), blocks(F.col("m") - F.col("top.m"), F.col("shingles") - F.col("top.shingles")).alias("nr"))
    dealt = own.join(main, "c").withColumn("is_top", F.col("root") == F.col("top"))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("v", F.lit(11)), F.when(F.col("is_top"), F.col("nt")).otherwise(F.col("nr"))).cast("int")).where("nr > 0")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    against_top = lambda: F.transform(upto(F.col("nt")), lambda i: F.struct(i.alias("i"), (-1 - F.col("at")).alias("j")))
    against_rest = lambda: F.transform(upto(F.col("nr")), lambda j: F.struct((-1 - F.greatest(F.col("at"), j)).alias("i"), (-1 - F.least(F.col("at"), j)).alias("j")))
    groups = F.when(F.col("is_top"), F.transform(upto(F.col("nr")), lambda j: F.struct(F.col("at").alias("i"), (-1 - j).alias("j")))).otherwise(F.concat(against_top(), against_rest()))
    sent = dealt.withColumn("g", F.explode(groups)).select("c", "g.i", "g.j", "v", "root", F.when(F.col("is_top"), F.col("at")).otherwise(-1 - F.col("at")).alias("block"))
    sent = sent.join(texts, "v").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "block", "v")
    return sent.select("c", "i", "j", "block", "v", "root", "text").mapInArrow(_block_links(size, threshold), "a long, b long").distinct()


def _block_links(size: int, threshold: tuple[int, int]):
    num, den = threshold

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = list(shingle_sets([r[3] for r in rows], size))
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        grams, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(column, minlength=len(grams)) > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], place[column[keep]]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(shared.sum()), 4096):
            i, j = np.searchsorted(column, (lo, lo + 4096))
            part = np.zeros((len(sets), 4096), dtype=np.float32)
            part[owner[i:j], column[i:j] - lo] = 1
            common += part @ part.T
        both = common.astype(np.int64)
        joint = sizes[:, None] + sizes[None, :] - both
        found = np.triu(den * both >= num * joint, 1)
        parent = {r[2]: r[2] for r in rows}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(found), strict=True):
            p, q = top(rows[x][2]), top(rows[y][2])
            if p != q:
                parent[p] = q
                out.append((min(rows[x][1], rows[y][1]), max(rows[x][1], rows[y][1])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            found = solve(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for part in _pieces(batches):
            for c, i, j, block, v, root, text in zip(*(x.to_pylist() for x in part.columns), strict=True):
                if (c, i, j) != key:
                    if rows:
                        yield flush()
                    key, rows = (c, i, j), []
                rows.append((block, v, root, text))
        if rows:
            yield flush()

    return run


def _first() -> Column:
    """The row that stands for others: least doc_id, null ids last, then least text key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t")).alias("first")


def _texts(docs: DataFrame, holders: DataFrame, size: int) -> DataFrame:
    """(v, text) with one text for each vertex of ``holders`` (v, doc_id, t), null ids included."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            ids = [set_id(x) if len(x) else None for x in shingle_sets(part.column("text").to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([part.column("v"), part.column("text"), pa.array(ids, pa.int64())], names=["v", "text", "own"])

    held = holders.select("v", F.col("doc_id").alias("_d"), F.col("t").alias("_t"))
    # Shuffled at every size: a small table of holders, broadcast, would only make small runs look cheaper than large ones.
    found = docs.join(held.hint("merge"), (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("v", "text")
    return found.mapInArrow(own, "v long, text string, own long").where("v = own").dropDuplicates(["v"]).select("v", "text")


def op6_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
