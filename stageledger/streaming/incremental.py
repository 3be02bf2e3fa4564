"""Files that come and go: batches as a stream, each new file once; fingerprints that read what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys
from ..sources.recordlog import RecordLog
from ..sources.tables import discard, materialize


def append_new(spark: SparkSession, source: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, max_files: int = 1000) -> int:
    """Run ``step`` over files of ``source`` not yet seen by ``checkpoint``; returns the batches done.

    ``step`` sees one micro-batch and may be any DataFrame code. Unlike a batch
    stage's records, the checkpoint doesn't notice when ``target`` loses files.
    """
    done: list[int] = []

    def write(df: DataFrame, epoch: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")  # a repeated epoch replaces itself
        done.append(epoch)

    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", max_files).parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return len(done)


def incremental_fingerprint(spark: SparkSession, source: str, state: str) -> tuple[tuple[int, str, str], list[str]]:
    """((n, a, b) of all rows of ``source``, the files read for it).

    The sums of each file are kept in a record log under ``state``; a file counts as the same while its size and change stamp
    do. The listing is Spark's, without reading contents. A full pass gives the same.
    """
    log = RecordLog(spark, state)
    current = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    current = current.where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]")).select(F.col("path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("stamp"))
    kept = log.state(kind="sums").select(F.col("name").alias("file"), F.from_json("body", "size long, stamp long, n long, a decimal(38,0), b decimal(38,0)").alias("s")).select("file", "s.*")
    known = materialize(kept, "sums")
    schema = spark.read.parquet(source).schema
    sums, fresh = keys.renewed_sums(known, current, lambda files: spark.read.schema(schema).parquet(*files))
    sums = materialize(sums, "sums")
    row = keys.summed(sums).first()
    body = F.to_json(F.struct("size", "stamp", "n", F.col("a"), F.col("b")))
    gone = known.join(sums.select("file"), "file", "left_anti").select("file", F.lit(None).cast("string").alias("body"))
    changed = sums.join(known, ["file", "size", "stamp"], "left_anti").select("file", body.alias("body")).unionByName(gone)
    if not changed.isEmpty():
        log.append(changed.select(F.lit("sums").alias("kind"), F.col("file").alias("name"), "body"))
    for x in (known, sums):
        discard(x)
    return (row.n, row.a, row.b), fresh
