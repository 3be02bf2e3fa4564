"""Manifests of files and folder trees, listed and digested by Spark.

Listing goes from folder to folder: a task reads the folders dealt to it, and those
below them, until it has ``BUDGET`` entries; folders that it leaves open are dealt out
anew. A file whose path, size and change stamp are those of a cached digest isn't read;
the rest is dealt out by files and hashed in tasks, ``CHUNK`` bytes at a time.

Paths are local ones or URIs that ``pyarrow.fs`` knows. Links are refused: what they
lead to may change without the tree.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys
from .tables import discard, materialize, ship

#: Entries that a task lists before it hands folders back.
BUDGET = 20_000
CHUNK = 1 << 20
#: Reads of a file that changes meanwhile.
TRIES = 3
VERSION = 1

ENTRIES = "path string, kind string, size long, stamp long, open boolean"
#: Digests known by path: what :func:`hashed` takes and gives.
CACHE = "path string, size long, stamp long, version int, content_hash string"


def _opened(path: str) -> tuple[Any, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _entry(path: str, prefix: str, info: Any) -> tuple[str, str, int, int]:
    if not prefix and os.path.islink(path):
        return path, "link", 0, 0
    kind = "dir" if info.type == pafs.FileType.Directory else "file"
    return prefix + info.path, kind, 0 if kind == "dir" else info.size, info.mtime_ns or 0


def _stat(path: str) -> tuple[str, str, int, int]:
    """(path, kind, size, stamp) of one path."""
    fs, inner = _opened(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"input {path!r} doesn't exist")
    return (path, *_entry(path, path[: len(path) - len(inner)] if "://" in path else "", info)[1:])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "kind", "size", "stamp", "open"]
    for batch in batches:
        todo, rows = batch.column("path").to_pylist(), []
        while todo:
            folder = todo.pop()
            if len(rows) >= BUDGET:
                rows.append((folder, "dir", 0, 0, True))
                continue
            fs, inner = _opened(folder)
            prefix = folder[: len(folder) - len(inner)] if "://" in folder else ""
            for info in fs.get_file_info(pafs.FileSelector(inner)):
                entry = _entry(info.path, prefix, info)
                if entry[1] == "dir":
                    todo.append(entry[0])
                rows.append((*entry, False))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=names)


def _dealt(paths: DataFrame, n: int) -> DataFrame:
    """``n`` paths over the cluster's tasks: by number, as what they lead to is far larger than they are."""
    k = min(n, 4 * paths.sparkSession.sparkContext.defaultParallelism)
    return paths.coalesce(1) if k <= 1 else paths.repartition(k)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, kind, size, stamp) of a file, or of a folder and all below it, empty folders too; written."""
    ship(spark)
    first = _stat(root)
    top = spark.createDataFrame([(*first, first[1] == "dir")], ENTRIES)
    tables = [top]
    frontier, k = top.where("open").select("path"), 1
    while first[1] == "dir":
        found = materialize(_dealt(frontier, k).mapInArrow(_list, ENTRIES), "listing")
        tables.append(found)
        frontier = found.where("open").select("path")
        k = frontier.count()
        if not k:
            break
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t.where("not open"))
    name = F.when(F.col("path") == root, ".").otherwise(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"))
    out = materialize(every.select("path", name.alias("name"), "kind", "size", "stamp"), "manifest")
    for t in tables[1:]:
        discard(t)
    if links := out.where("kind = 'link'").select("path").head(1):
        raise ValueError(f"an input is a link: {links[0].path}")
    return out


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            fs, inner = _opened(path)
            for _ in range(TRIES):
                before, h = _stat(path), hashlib.sha256()
                with fs.open_input_stream(inner) as f:
                    while block := f.read(CHUNK):
                        h.update(block)
                if _stat(path) == before:
                    break
            else:
                raise RuntimeError(f"{path} changes while it is read")
            rows.append((path, before[2], before[3], VERSION, f"sha256:{h.hexdigest()}"))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, types, strict=True)], names=["path", "size", "stamp", "version", "content_hash"])


def hashed(listing: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with content_hash, rows for the cache): only files that the cache doesn't know as they are get read."""
    files = listing.where("kind = 'file'").select("path", "size", "stamp", F.lit(VERSION).alias("version"))
    judged = materialize(keys.stat_shortcut(files, cache), "judged")
    fresh = judged.where("action <> 'cached'").select("path")
    fresh = materialize(_dealt(fresh, fresh.count()).mapInArrow(_hash, CACHE), "hashes")
    known = judged.where("action = 'cached'").select("path", F.col("reused").alias("content_hash")).unionByName(fresh.select("path", "content_hash"))
    return listing.join(known, "path", "left"), fresh


def digest(entries: DataFrame) -> str:
    """One digest of a manifest: names below the root, kinds and contents, never stats."""
    row = keys.dataset_fingerprint(entries.select("name", "kind", F.coalesce("content_hash", F.lit("")).alias("content_hash"))).first()
    return f"{row.n}:{row.a}:{row.b}"
