"""Sharding by fixed virtual slots (DataFrame functions only).

Every record hashes into one of ``N_SLOTS`` virtual slots, for good. The bytes of
each slot are summed, and a slot map (version, virtual_slot, shard, bytes, n_rows,
base) deals whole slots to shards: the largest slot first, each to the lightest
shard. The map is written as ``<root>/version=<n>``; rebalancing edits it, moving
the fewest slots from shards above the mean to shards below it, and writes the
next version. A record's place in its shard is its slot's ``base`` (rows of the
shard's earlier slots) plus its rank within the slot, so no window spans a shard; a
slot of more than 1 / ``N_SLOTS`` of all rows (repeated rows) is ranked in strips.

Only the map and the strips' bases are broadcast: at most 3 ``N_SLOTS`` rows.

Defined cases: a null text has no bytes and checksum 0; a null doc_id hashes by its
text; repeated rows keep a place each; an empty table gives an empty result and a
map of empty slots; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, table

N_SLOTS = 4096
N_SHARDS = 16
LAW = "bytes"

MAP = "version int, virtual_slot int, shard int, bytes long, n_rows long, base long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, uid (any, for strips) and the record's virtual slot."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.monotonically_increasing_id().alias("uid"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(N_SLOTS)).cast("int"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, n_rows for all ``N_SLOTS`` slots, empty ones too."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = rows.sparkSession.range(N_SLOTS).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(found), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def _with_bases(slots: DataFrame, version: int) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "n_rows", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))


def first_map(totals: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1: slots by falling bytes, each to the shard with the fewest bytes so far (then rows)."""
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
        F.expr("cast(array() as array<int>)").alias("shards"),
    )

    def put(state, slot):
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda x, i: F.when(i == lightest, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["shards"], F.array(lightest)).alias("shards"))

    # One row of N_SLOTS entries.
    row = totals.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes", "n_rows"))).alias("slots"))
    dealt = row.select("slots", F.aggregate("slots", start, put)["shards"].alias("shards"))
    one = dealt.select(F.explode(F.arrays_zip("slots", "shards")).alias("x"))
    return _with_bases(one.select("x.slots.virtual_slot", F.col("x.shards").alias("shard"), "x.slots.bytes", "x.slots.n_rows"), 1)


def edit_map(slot_map: DataFrame, totals: DataFrame, n_shards: int, version: int) -> DataFrame:
    """The next version for new ``totals`` or more shards.

    Each shard above the mean gives up the slots beyond its mean share (its largest
    slots stay); the given-up bytes, in one row, fill the room of the shards below
    the mean in order. Slots of other shards keep their place.
    """
    slots = slot_map.select("virtual_slot", "shard").join(totals, "virtual_slot")
    everything = Window.partitionBy()  # N_SLOTS rows
    falling = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    ranked = slots.withColumn("upto", F.sum("bytes").over(falling)).withColumn("mean", F.sum("bytes").over(everything) / n_shards)
    stay, given = ranked.where("upto <= mean or bytes = 0"), ranked.where("upto > mean and bytes > 0")
    shards = slots.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("to"))
    kept = stay.groupBy(F.col("shard").alias("to")).agg(F.sum("bytes").alias("kept"), F.max("mean").alias("mean"))
    room = shards.join(kept, "to", "left").withColumn("mean", F.max("mean").over(everything)).select("to", F.greatest(F.col("mean") - F.coalesce("kept", F.lit(0)), F.lit(0.0)).alias("room"))
    order = Window.orderBy("to")  # n_shards rows
    room = room.withColumn("hi", F.sum("room").over(order)).withColumn("lo", F.col("hi") - F.col("room")).where("room > 0")
    queue = given.withColumn("mid", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "virtual_slot")) - F.col("bytes") / 2)  # under N_SLOTS rows
    moved = queue.join(F.broadcast(room), (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi")), "left")
    columns = ["virtual_slot", "shard", "bytes", "n_rows"]
    moved = moved.select("virtual_slot", F.coalesce("to", "shard").alias("shard"), "bytes", "n_rows")
    return _with_bases(stay.select(*columns).unionByName(moved), version)


def store_map(slot_map: DataFrame, root: str, version: int) -> DataFrame:
    slot_map.coalesce(1).write.parquet(f"{root}/version={version}")
    return slot_map.sparkSession.read.schema(MAP).parquet(f"{root}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless place of every record under a stored map. ``rows`` is read twice: a written table."""
    everything = Window.partitionBy()  # N_SLOTS rows
    strips = F.ceil(F.col("n_rows") * N_SLOTS / F.greatest(F.sum("n_rows").over(everything), F.lit(1))).cast("long")
    mapped = rows.join(F.broadcast(slot_map.withColumn("strips", F.greatest(strips, F.lit(1)))), "virtual_slot")
    mapped = mapped.withColumn("strip", F.pmod(F.xxhash64("uid"), F.col("strips")))
    before = Window.partitionBy("virtual_slot").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    bases = mapped.groupBy("virtual_slot", "strip").agg(F.count("*").alias("n")).select("virtual_slot", "strip", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("virtual_slot", "strip").orderBy("doc_id", "text_crc32", "uid")
    ranked = mapped.withColumn("rank", F.row_number().over(within).cast("long") - 1).join(F.broadcast(bases), ["virtual_slot", "strip"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("earlier") + F.col("rank")).alias("slot"), "virtual_slot", "version")


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(digests(table(spark, sf_dir, "documents")), "slots")
    slot_map = store_map(first_map(slot_totals(rows)), fresh_path(spark, "slot-map"), 1)
    placed = place(rows, slot_map)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")
