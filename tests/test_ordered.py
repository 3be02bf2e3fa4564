import random
from datetime import datetime, timedelta

from stageledger.streaming.ordered import in_order, release_in_order

ITEMS = "stage string, index long, item string, at timestamp"
COLUMNS = ["stage", "index", "item", "gap"]
START = datetime(2024, 1, 1)


def drained(spark, folder, patience="10 minutes"):
    """What a stream over ``folder``/in that stops after each file, and starts anew, has released so far."""
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = release_in_order(stream, patience).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").select(*COLUMNS).collect()))


def test_restarts_equal_a_batch_run(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"s{k}", i, f"{k}-{i}", START + timedelta(seconds=i)) for k in range(3) for i in range(20) if (k, i) != (1, 11)]
    rng.shuffle(rows)
    rows += rows[:5]  # repeated items
    rows += [(None, 0, "x", START), ("s0", None, "x", START), ("s0", -1, "x", START)]
    for n in range(3):
        spark.createDataFrame(rows[n::3], ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = drained(spark, tmp_path)
    whole = spark.read.parquet(str(tmp_path / "in"))
    assert found == sorted(map(tuple, in_order(whole).select(*COLUMNS).collect()))
    assert len(found) == 51 and max(i for s, i, *_ in found if s == "s1") == 10


def test_a_missing_item_is_given_up_after_a_while(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    for rows in ([("a", 0, "x", at(0)), ("a", 2, "z", at(2))], [("b", 0, "x", at(500))], [("b", 1, "y", at(501))]):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = drained(spark, tmp_path, "5 seconds")
    assert found == [("a", 0, "x", False), ("a", 2, "z", True), ("b", 0, "x", False), ("b", 1, "y", False)]
