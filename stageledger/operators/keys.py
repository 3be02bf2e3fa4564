"""Keys and manifests: canonical JSON, digests, projections, content fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_json(m: Column) -> Column:
    """A flat string map with sorted keys, as compact JSON."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def project(config: Column, access: Column) -> Column:
    """Only the fields that were read; a null access set means all of them."""
    return F.when(access.isNull(), config).otherwise(F.map_filter(config, lambda k, _: F.array_contains(access, k)))


def merge_access(recorded: Column, previous: Column, has_previous: Column, same_source: Column) -> Column:
    """None (all) dominates; under one source reads add up, under another they replace."""
    return F.when(recorded.isNull() | (same_source & has_previous & previous.isNull()), F.lit(None)).when(same_source & has_previous, F.array_sort(F.array_union(recorded, previous))).otherwise(F.array_sort(recorded))


def merge_config(base: Column, override: Column) -> Column:
    """Flat merge in which an override's explicit null wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(override), k)), override)


def override_name(canonical: Column) -> Column:
    return F.concat(F.lit("main_override_"), F.substring(F.sha2(canonical, 256), 1, 12))


def input_key(config: Column, inputs: Column, values: Column, upstreams: Column, source: Column) -> Column:
    """SHA-256 of the canonical JSON of the five parts, names in order. Parts are JSON texts but the source."""
    quoted = F.concat(F.lit('"'), source, F.lit('"'))
    parts = [("config", config), ("inputs", inputs), ("rerun_source_fingerprint", quoted), ("upstreams", upstreams), ("values", values)]
    return sha256(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), c) for n, c in parts]), F.lit("}")))


#: Members of a node of a digest tree.
FAN = 1024


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rank``: each row's place in its group, from 0, without a group in one task.

    Rows are dealt by ranges of (group, order); a row's place is its place in its part,
    plus what the parts before it have of its group.
    """
    dealt = materialize(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    before = counts.select(F.col("_part").alias("_b"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], so_far.alias("_before"))
    same = null_safe_equal([(F.col("_part"), F.col("_b")), *[(F.col(c), F.col(f"_b{i}")) for i, c in enumerate(by)]])
    placed = dealt.join(before, same).select(*dealt.columns, "_before")
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    return placed.withColumn("rank", (F.col("_before") + own).cast("long")).drop("_before", "_part")


def ordered_hash(rows: DataFrame, by: list[str], order: list[str], item: Column, fan: int = FAN) -> DataFrame:
    """(*by, fingerprint, members): one digest of each group's items in order, as a tree.

    ``fan`` items in a row make a leaf, ``fan`` digests in a row the node above, until a
    group has one node. A row of any step holds ``fan`` digests at most, and a group's
    leaves are made wherever its ranges lie. ``order`` places each item of a group;
    items that it leaves tied are in order of their text.
    """
    items = rows.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], item.alias("_i"))
    placed = ranked(items, by, [f"_o{i}" for i in range(len(order))] + ["_i"])
    nodes = placed.select(*by, "rank", F.coalesce("_i", F.lit("")).alias("_i"), F.lit(1).cast("long").alias("_m"))
    most = fan
    at = F.floor(F.col("rank") / fan).cast("long")
    fold = lambda frame, digest: frame.groupBy(*by, at.alias("_at")).agg(F.array_sort(F.collect_list(F.struct("rank", "_i"))).alias("_e"), F.sum("_m").alias("_m")).select(*by, F.col("_at").alias("rank"), digest.alias("_i"), "_m")
    joined = sha256(F.array_join(F.transform("_e", lambda x: x["_i"]), "\n"))
    nodes = materialize(fold(nodes, joined), "leaves")
    largest = nodes.agg(F.max("rank")).first()[0]
    while largest is not None and largest * fan >= most:  # a lone node is its group's digest already
        nodes = fold(nodes, F.when(F.size("_e") == 1, F.get("_e", F.lit(0))["_i"]).otherwise(joined))
        most *= fan
    return nodes.select(*by, F.col("_i").alias("fingerprint"), F.col("_m").alias("members"))


def manifest(files: DataFrame) -> DataFrame:
    """Members of named inputs, once per path."""
    return files.dropDuplicates(["name", "path"]).select("name", "path", "kind", "content_hash")


def digest_view(files: DataFrame, fan: int = FAN) -> DataFrame:
    """What of a file enters a key: path, kind and content, never its stat."""
    return ordered_hash(manifest(files), ["name"], ["path"], F.concat_ws("|", "path", "kind", "content_hash"), fan)


def stat_shortcut(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Reuse a cached hash while path, size and change stamp agree; the rest is hashed anew."""
    cached = cache.select("path", F.col("size").alias("_s"), F.col("stamp").alias("_t"), F.col("version").alias("_v"), F.col("content_hash").alias("_h"))
    same = (F.col("size") == F.col("_s")) & (F.col("stamp") == F.col("_t")) & (F.col("version") == F.col("_v"))
    kind = F.when(F.col("_h").isNull(), "new").when(same, "cached").otherwise("rehash")
    return listing.join(cached, "path", "left").select("path", kind.alias("action"), F.when(same, F.col("_h")).alias("reused"))


def component_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Added, removed and changed entries; what is equal (null-safe) falls out."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change is not null")


def without_rerun(review: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """A file under both policies is the rerun policy's."""
    return review.join(rerun.select(key), key, "left_anti")


def _hashable(column: Column, kind: T.DataType) -> Column:
    """Maps as sorted entries, at any depth that a hash can't take them."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), _hashable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.struct(*[_hashable(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return column


def fast_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of a row; a mask of nulls is among what is hashed, so that swapped nulls show."""
    columns = [_hashable(df[f.name], f.dataType) for f in df.schema.fields]
    mask = F.concat(F.lit(""), *[F.when(df[f.name].isNull(), "1").otherwise("0") for f in df.schema.fields])
    return F.xxhash64(F.lit(seed), mask, *columns)


def exact_double(x: Column) -> Column:
    """A double as sign, exponent and 52 bits of fraction: the same text in every engine."""
    x = x.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    low = F.pow(F.lit(2.0), guess.cast("double"))
    # A logarithm may be off by one at a power of two; the quotient by one is exact.
    exponent = guess + F.when(size / low < 1, -1).when(size / low >= 2, 1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * 2.0**52).cast("long")
    text = F.concat(F.when(x < 0, "-").otherwise("+"), exponent.cast("string"), F.lit(":"), fraction.cast("string"))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("+inf")).when(x == 0, "0").otherwise(text)


def portable_hash(df: DataFrame, seed: int) -> Column:
    """60 bits of the MD5 of a row's canonical text: what another engine can compute too.

    Fields in order, each ``length:text``, null ``-``; doubles exact, times in microseconds.
    """
    texts = []
    for f in df.schema.fields:
        c = df[f.name]
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = exact_double(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp")).cast("string")
        elif isinstance(f.dataType, T.AtomicType):
            c = c.cast("string")
        else:
            raise TypeError(f"{f.name!r} has no portable text: {f.dataType.simpleString()}")
        texts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed};"), *texts)), 1, 15), 16, 10).cast("long")


def fingerprint_aggregates(df: DataFrame, row_hash: Callable[[DataFrame, int], Column] = fast_hash, where: Column | None = None, prefix: str = "") -> list[Column]:
    """n, a, b: a digest of the rows as a multiset, whatever their order or files.

    Two seeded hashes per row are summed as decimals, so repeated rows show. One pass,
    partial sums only. With ``where``, of those rows alone.
    """
    only = lambda c: c if where is None else F.when(where, c)
    total = lambda seed: F.coalesce(F.sum(only(row_hash(df, seed).cast("decimal(38,0)"))), F.lit(0)).cast("string")
    return [F.count(only(F.lit(1))).alias(f"{prefix}n"), total(17).alias(f"{prefix}a"), total(42).alias(f"{prefix}b")]


def dataset_fingerprint(df: DataFrame, row_hash: Callable[[DataFrame, int], Column] = fast_hash) -> DataFrame:
    """One row of :func:`fingerprint_aggregates`."""
    return df.agg(*fingerprint_aggregates(df, row_hash))


SUMS = "file string, size long, stamp long, n long, a decimal(38,0), b decimal(38,0)"


def file_sums(df: DataFrame, row_hash: Callable[[DataFrame, int], Column] = fast_hash) -> DataFrame:
    """``SUMS``: :func:`fingerprint_aggregates` for each file of a dataset that is read from files, in one pass."""
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.unix_micros("_metadata.file_modification_time").alias("stamp"), *[row_hash(df, seed).cast("decimal(38,0)").alias(f"_{seed}") for seed in (17, 42)])
    return rows.groupBy("file", "size", "stamp").agg(F.count("*").alias("n"), F.sum("_17").alias("a"), F.sum("_42").alias("b"))


def summed(sums: DataFrame) -> DataFrame:
    """The dataset's fingerprint from its files' sums: that of :func:`dataset_fingerprint`."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").cast("string").alias(c)
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), total("a"), total("b"))


def renewed_sums(known: DataFrame, current: DataFrame, read: Callable[[list[str]], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(sums of the files that are there now, files read): added and rewritten files are read, removed ones fall out.

    ``current`` (file, size, stamp) is the listing; ``read`` opens some files.
    """
    same = ["file", "size", "stamp"]
    kept = known.join(current.select(*same), same, "left_semi")
    fresh = [r.file for r in current.join(known.select(*same), same, "left_anti").select("file").collect()]
    return (kept.unionByName(file_sums(read(fresh))), fresh) if fresh else (kept, fresh)


def null_safe_equal(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))
