import random
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from stageledger.operators import keys
from stageledger.streaming.incremental import incremental_fingerprint


def test_equal_to_a_full_pass_on_appends_deletes_and_rewrites(spark, tmp_path):
    rng, source, state = random.Random(4), tmp_path / "data", f"file://{tmp_path}/state"
    add = lambda n, seed, mode="append": spark.range(n).select((F.col("id") * seed).alias("k"), F.when(F.col("id") % 3 > 0, "x").alias("t")).repartition(2).write.mode(mode).parquet(str(source))
    add(50, 3)
    for step in range(4):
        before = {str(p) for p in source.glob("part-*")}
        if step == 1:
            add(20, 5)
        elif step == 2:
            Path(rng.choice(sorted(before))).unlink()
            add(7, 11)
        elif step == 3:
            one = spark.read.parquet(str(source)).limit(9).repartition(1)
            one.write.parquet(str(tmp_path / "one"))
            source.joinpath(f".{Path(sorted(before)[0]).name}.crc").unlink()
            shutil.copy(next((tmp_path / "one").glob("part-*")), sorted(before)[0])
        found, read = incremental_fingerprint(spark, str(source), state)
        assert found == tuple(keys.dataset_fingerprint(spark.read.parquet(str(source))).first())
        now = {str(p) for p in source.glob("part-*")}
        names = {Path(f.removeprefix("file:")).name for f in read}
        assert names == {Path(p).name for p in (now if not step else now - before if step < 3 else {sorted(before)[0]})}
    assert incremental_fingerprint(spark, str(source), state)[1] == []


def test_file_sums_add_up(spark, tmp_path):
    spark.range(100).withColumn("d", F.col("id") / 7).repartition(5).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    for row_hash in (keys.fast_hash, keys.portable_hash):
        assert keys.file_sums(df, row_hash).count() == 5
        assert keys.summed(keys.file_sums(df, row_hash)).first() == keys.dataset_fingerprint(df, row_hash).first()
