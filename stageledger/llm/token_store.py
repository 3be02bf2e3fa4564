"""Token-ID output: a content-addressed store of id chunks.

File format (all tables are Parquet under one root in the shared folder):

``packs``     doc_id, uid, seq, hash, n, payload. One row per chunk of a document.
              ``hash`` is BLAKE2b-128 of the ids as little-endian ``width``-byte
              integers; exactly one row of each hash carries those bytes.
``recipes``   part, pos, doc_id, uid, n_tokens, local_start, hashes, lens, leaf,
              part_root. Documents in ascending (doc_id, uid) order, cut into parts
              by range; ``hashes`` joins the 16-byte chunk hashes in order, ``leaf``
              is the SHA-256 of doc_id, uid, lengths and hashes, ``part_root`` (last
              row of a part) the Merkle root of the part's leaves.
``manifest``  part, n_docs, n_tokens, base, root: one row per part; ``base`` counts
              the ids of all parts before it.

Reading verifies all of it, and fails otherwise: bytes against their address, recipes
against their leaf, each part's places, counts and root against the manifest, and
that no chunk, recipe, part or manifest row is missing. ``store_root`` is the one
hash to keep elsewhere: given as ``expected``, a manifest that was rewritten to fit
altered recipes fails too.

Chunk ends are content-defined: a rolling polynomial hash of the last ``WINDOW``
ids picks them, so equal runs of ids are cut alike wherever they stand.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts
first; repeated doc_ids and repeated rows are documents of their own, ordered by
``uid`` (their place in the input); an empty table gives empty tables; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, partitions, ship, table
from .tokens import Encoder, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 8
MIN_CHUNK, MASK, MAX_CHUNK = 64, 0xFF, 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)

PACKS = "doc_id long, uid long, seq int, hash binary, n int, payload binary"
RECIPES = "part int, pos long, doc_id long, uid long, n_tokens long, local_start long, hashes binary, lens binary, leaf binary, part_root binary"


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids asks for a cut."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        rolling = mixed.copy()
        weight = np.uint64(1)
        for back in range(1, WINDOW):
            weight = np.uint64((int(weight) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF)
            rolling[back:] += mixed[:-back] * weight
        return np.flatnonzero(((rolling * _BASE) >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cut_points(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids, given the marks in them; the last is n.

    Marks before MIN_CHUNK (over WINDOW) never cut, so those that the ids of an
    earlier document took part in don't matter.
    """
    ends, at = [], 0
    for mark in [*found, n]:
        while mark - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if mark - at >= MIN_CHUNK or mark == n and mark > at:
            at = mark
            ends.append(at)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is."""
    level = list(leaves)
    while len(level) > 1:
        up = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def leaf(doc: int | None, uid: int, lens: bytes, hashes: bytes) -> bytes:
    """What a recipe is known by: each field has a fixed size or a length before it."""
    head = struct.pack("<?qqq", doc is None, doc or 0, uid, len(lens))
    return hashlib.sha256(head + lens + hashes).digest()


def _encode(vocabulary: str, end_id: int, width: int):
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary, dtype), np.array([end_id], dtype=dtype).tobytes()
        seen: set[bytes] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                docs, uids = part.column("doc_id").to_pylist(), part.column("uid").to_pylist()
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                encoded = [ids + end for ids in encoder.encode(part.column("text").to_pylist())]
                found, first = marks(np.frombuffer(b"".join(encoded), dtype=dtype)).tolist(), 0
                docs_, uids_, seqs, digests, sizes, payloads = rows
                for doc, uid, ids in zip(docs, uids, encoded, strict=True):
                    n = len(ids) // width
                    own = found[bisect_right(found, first) : bisect_left(found, first + n)]
                    at = 0
                    for seq, stop in enumerate(cut_points([x - first for x in own], n)):
                        payload = ids[at * width : stop * width]
                        digest = hashlib.blake2b(payload, digest_size=16).digest()
                        docs_.append(doc)
                        uids_.append(uid)
                        seqs.append(seq)
                        digests.append(digest)
                        sizes.append(stop - at)
                        payloads.append(None if digest in seen else payload)
                        if len(seen) < 1_000_000:  # beyond, a copy more is sent; the next step still keeps one
                            seen.add(digest)
                        at = stop
                    first += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.binary())],
                    names=["doc_id", "uid", "seq", "hash", "n", "payload"],
                )

    return run


def _keep_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows with one hash and a payload meet here; the first keeps its payload."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest, there in zip(batch.column("hash").to_pylist(), batch.column("payload").is_valid().to_pylist(), strict=True):
            keep.append(there and digest not in seen)
            if there:
                seen.add(digest)
        payload = pyarrow.compute.if_else(pa.array(keep), batch.column("payload"), pa.scalar(None, pa.binary()))
        yield batch.set_column(batch.schema.get_field_index("payload"), "payload", payload)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of one part in (doc_id, uid, seq) order -> one row per document."""
    from pyspark import TaskContext

    part, pos, start = TaskContext.get().partitionId(), 0, 0
    leaves: list[bytes] = []
    open_key: tuple | None = None
    hashes: list[bytes] = []
    lens: list[int] = []

    def close() -> list:
        nonlocal pos, start
        joined, packed = b"".join(hashes), np.array(lens, dtype="<u4").tobytes()
        leaves.append(leaf(*open_key, packed, joined))
        row = [part, pos, open_key[0], open_key[1], sum(lens), start, joined, packed, leaves[-1], None]
        pos, start = pos + 1, start + sum(lens)
        return row

    def out(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = [x.split()[0] for x in RECIPES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows = []
        for doc, uid, digest, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "hash", "n")), strict=True):
            if (doc, uid) != open_key:
                if open_key is not None:
                    rows.append(close())
                open_key, hashes, lens = (doc, uid), [], []
            hashes.append(digest)
            lens.append(n)
        if rows:
            yield out(rows)
    if open_key is not None:
        row = close()
        row[-1] = merkle_root(leaves)
        yield out([row])


def write_store(docs: DataFrame, root: str, vocabulary: str, end_id: int = END_ID, width: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) and write the store's three tables under ``root``.

    One shuffle moves chunk bytes (to meet their copies), one moves recipe rows.
    Rows without payload are dealt by document, so a chunk that many documents
    share puts at most one row per map task on its partition.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    key = F.when(F.col("payload").isNotNull(), F.xxhash64("hash")).otherwise(F.xxhash64("uid", "seq"))
    chunks = rows.mapInArrow(_encode(vocabulary, end_id, width), PACKS).repartition(n, key)
    chunks.mapInArrow(_keep_first, PACKS).write.option("compression", "zstd").parquet(f"{root}/packs")
    refs = spark.read.schema(PACKS).parquet(f"{root}/packs").select("doc_id", "uid", "seq", "hash", "n")
    ordered = refs.repartitionByRange(n, "doc_id", "uid").sortWithinPartitions("doc_id", "uid", "seq")
    ordered.mapInArrow(_recipes, RECIPES).write.option("compression", "zstd").parquet(f"{root}/recipes")
    parts = spark.read.schema(RECIPES).parquet(f"{root}/recipes").groupBy("part").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("part_root").alias("root")
    )
    base, listed = 0, []
    for x in sorted(parts.collect()):  # one row per part: at most as many as shuffle partitions
        listed.append((x.part, x.n_docs, x.n_tokens, base, bytes(x.root)))
        base += x.n_tokens
    spark.createDataFrame(listed, "part int, n_docs long, n_tokens long, base long, root binary").coalesce(1).write.parquet(f"{root}/manifest")


def store_root(spark: SparkSession, root: str) -> bytes:
    """Merkle root of the whole store, over the parts' roots in order."""
    return merkle_root([bytes(x.root) for x in sorted(spark.read.parquet(f"{root}/manifest").collect())])


_SHIFTS: list[np.ndarray] = []


def _shift_tables() -> list[np.ndarray]:
    """For each power 2^j: tables that append 2^j zero bytes to a CRC-32."""
    if not _SHIFTS:
        basis = np.array([zlib.crc32(b"\0", 0xFFFFFFFF ^ (1 << i)) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for i in range(32)], dtype=np.uint32)
        for _ in range(44):
            tables = np.zeros((4, 256), dtype=np.uint32)
            for byte in range(4):
                for bit in range(8):
                    tables[byte, 1 << bit : 2 << bit] = tables[byte, : 1 << bit] ^ basis[8 * byte + bit]
            _SHIFTS.append(tables)
            basis = _apply(tables, basis)
    return _SHIFTS


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds to the whole's when ``n_bytes`` more follow; the whole is their XOR."""
    crc = crc.astype(np.uint32)
    left = n_bytes.astype(np.int64).copy()
    for t in _shift_tables():
        if not left.any():
            break
        odd = (left & 1).astype(bool)
        crc[odd] = _apply(t, crc[odd])
        left >>= 1
    return crc


def _read_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, crcs, sizes = batch.column("hash").to_pylist(), [], []
            for digest, payload in zip(digests, batch.column("payload").to_pylist(), strict=True):
                if hashlib.blake2b(payload, digest_size=16).digest() != digest:
                    raise ValueError(f"a chunk's bytes don't match its address {digest.hex()}")
                ids = np.frombuffer(payload, dtype=f"<u{width}")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["hash", "crc", "size"])

    return run


def _open_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for doc, uid, n_tokens, hashes, lens, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "n_tokens", "hashes", "lens", "leaf")), strict=True):
            n = np.frombuffer(lens, dtype="<u4").astype(np.int64)
            if leaf(doc, uid, lens, hashes) != own or n.sum() != n_tokens or 16 * len(n) != len(hashes) or not len(n):
                raise ValueError(f"a recipe doesn't match its leaf {own.hex()}")
            after = (n.sum() - np.cumsum(n)) * 4
            rows[0].extend([uid] * len(n))
            rows[1].extend(hashes[16 * i : 16 * i + 16] for i in range(len(n)))
            rows[2].extend(n.tolist())
            rows[3].extend(after.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], names=["uid", "hash", "n", "after"])


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column("size").null_count:
            raise ValueError("a chunk is missing")
        if (batch.column("n").to_numpy() != batch.column("size").to_numpy()).any():
            raise ValueError("a recipe's lengths don't match its chunks")
        crc = shift_crc(batch.column("crc").to_numpy(), batch.column("after").to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(crc, pa.int64())], names=["uid", "crc"])


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole parts in (part, pos) order -> part, its counts and the root of its leaves."""
    part, leaves, tokens = None, [], 0

    def close() -> pa.RecordBatch:
        values = ((part, pa.int32()), (len(leaves), pa.int64()), (tokens, pa.int64()), (merkle_root(leaves), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=["part", "found_docs", "found_tokens", "found_root"])

    for batch in batches:
        for p, pos, n_tokens, start, own in zip(*(batch.column(c).to_pylist() for c in ("part", "pos", "n_tokens", "local_start", "leaf")), strict=True):
            if p != part:
                if part is not None:
                    yield close()
                part, leaves, tokens = p, [], 0
            if pos != len(leaves) or start != tokens:
                raise ValueError(f"a recipe of part {p} is missing or out of place")
            leaves.append(own)
            tokens += n_tokens
    if part is not None:
        yield close()


def verified_parts(spark: SparkSession, root: str) -> DataFrame:
    """part, base: a row per part of the manifest; fails where its recipes aren't those it was written for.

    A part's leaves (32 bytes a document) meet in one task, as when it was written.
    """
    recipes = spark.read.schema(RECIPES).parquet(f"{root}/recipes").select("part", "pos", "n_tokens", "local_start", "leaf")
    ordered = recipes.repartition(partitions(spark), "part").sortWithinPartitions("part", "pos")
    found = ordered.mapInArrow(_part_roots, "part int, found_docs long, found_tokens long, found_root binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part: at most the writer's shuffle partitions
    manifest = spark.read.parquet(f"{root}/manifest").withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    same = F.col("root").eqNullSafe(F.col("found_root")) & F.col("n_docs").eqNullSafe(F.col("found_docs")) & F.col("n_tokens").eqNullSafe(F.col("found_tokens")) & F.col("base").eqNullSafe(F.col("before"))
    wrong = F.raise_error(F.concat(F.lit("the manifest doesn't match part "), F.col("part").cast("string")))
    # A filter, which no pruning of columns takes away.
    return manifest.join(found, "part", "full_outer").where(F.when(same, True).otherwise(wrong.cast("boolean"))).select("part", "base")


def read_digests(spark: SparkSession, root: str, width: int = 2, expected: bytes | None = None) -> DataFrame:
    """From the files, verified: doc_id, start, n_tokens, ids_crc32.

    Chunk bytes are read where they lie; only 16-byte hashes and checksums move.
    A chunk that many documents share is a skewed join key, which AQE splits.
    """
    ship(spark)
    if expected is not None and store_root(spark, root) != expected:
        raise ValueError("the store's root isn't the expected one")
    packs = spark.read.schema(PACKS).parquet(f"{root}/packs")
    recipes = spark.read.schema(RECIPES).parquet(f"{root}/recipes")
    chunks = packs.where("payload is not null").select("hash", "payload").mapInArrow(_read_chunks(width), "hash binary, crc long, size long")
    refs = recipes.select("doc_id", "uid", "n_tokens", "hashes", "lens", "leaf").mapInArrow(_open_recipes, "uid long, hash binary, n long, after long")
    shifted = refs.join(chunks, "hash", "left").select("uid", "n", "size", "crc", "after").mapInArrow(_shift, "uid long, crc long")
    whole = shifted.groupBy("uid").agg(F.bit_xor("crc").alias("ids_crc32"))
    # A row per part, at most as many as the writer's shuffle partitions; a part of recipes that the manifest lacks has failed there.
    rows = recipes.select("part", "uid", "doc_id", "n_tokens", "local_start").join(F.broadcast(verified_parts(spark, root)), "part")
    return rows.join(whole, "uid").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, root: str, width: int = 2) -> DataFrame:
    """doc_id, uid, ids: every document rebuilt from recipes and chunks."""
    ship(spark)
    packs = spark.read.schema(PACKS).parquet(f"{root}/packs")
    chunks = packs.where("payload is not null").select("hash", "payload")
    recipes = spark.read.schema(RECIPES).parquet(f"{root}/recipes").select("doc_id", "uid", "hashes")
    refs = recipes.select("doc_id", "uid", F.posexplode(F.sequence(F.lit(0), (F.octet_length("hashes") / 16).cast("int") - 1)).alias("seq", "i"), "hashes")
    refs = refs.select("doc_id", "uid", "seq", F.expr("substring(hashes, 16 * i + 1, 16)").alias("hash"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("parts").to_pylist()
            if any(x["payload"] is None for parts in found for x in parts):
                raise ValueError("a chunk is missing")
            ids = [np.concatenate([np.frombuffer(x["payload"], dtype=f"<u{width}") for x in parts]).astype(np.int32) for parts in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "uid", "ids"])

    grouped = refs.join(chunks, "hash", "left").groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
    return grouped.mapInArrow(build, "doc_id long, uid long, ids array<int>")


def op2_token_store(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    root = fresh_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), root, vocabulary or vocabulary_path(VOCABULARY))
    return read_digests(spark, root)
