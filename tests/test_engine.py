import dataclasses
import enum
import json
from collections import Counter
from typing import Literal

import pytest
from pyspark.sql import functions as F

from stageledger import Axis, Dependencies, Graph, Pipeline, batch_stage, matrix, stage
from stageledger.plans.engine import Blocked, Engine, PendingReview
from stageledger.sources.store import CorruptStore, Store, StoreLocked, discover
from stageledger.streaming.incremental import append_new


class Chain(Pipeline):
    @stage()
    def numbers(ctx):
        return ctx.spark.range(ctx.config["n"])

    @stage(needs=numbers)
    def small(ctx):
        return ctx.input("numbers").where(F.col("id") < 5)

    @stage(needs=small)
    def report(ctx):
        return ctx.input("small").agg(F.sum("id").alias("total")).withColumn("title", F.lit(ctx.config["title"]))


class Batches(Pipeline):
    fail_at = None

    @batch_stage()
    def parts(ctx):
        for i in ctx.resume(range(4)):
            if i == Batches.fail_at:
                raise RuntimeError("stop")
            yield ctx.spark.range(i + 1)

    @stage(needs=parts)
    def whole(ctx):
        return ctx.union("parts")


BENCH, MODEL = Axis("bench", ["a", "b"]), Axis("model", ["small", "large"])


class Matrix(Pipeline):
    @matrix(BENCH)
    @stage()
    def source(ctx, bench):
        return ctx.spark.createDataFrame([(bench,)], "bench string")

    @matrix(BENCH, MODEL)
    @stage(needs=source)
    def score(ctx, bench, model):
        return ctx.input("source").withColumn("model", F.lit(model))

    @stage(needs=score)
    def finish(ctx):
        return ctx.union("score")


def statuses(e, key="status"):
    return [p[key] for p in e.probe()]


def test_chain_reruns_only_what_changed(spark, tmp_path):
    root = str(tmp_path / "out")
    e = Engine(spark, Chain, root, {"n": 10, "title": "x"})
    assert statuses(e) == ["needs-run"] * 3
    assert [o["ran"] for o in e.run()] == [True] * 3
    assert statuses(e) == ["hit"] * 3
    assert [o["ran"] for o in e.run()] == [False] * 3
    # A field that one stage reads.
    e = Engine(spark, Chain, root, {"n": 10, "title": "y"})
    assert statuses(e) == ["hit", "hit", "needs-run"]
    assert e.probe()[2]["reason"].startswith('config: title "x" -> "y"')
    # A probe doesn't pass staleness on; a run stops where content is the same again.
    e = Engine(spark, Chain, root, {"n": 20, "title": "x"})
    assert statuses(e) == ["needs-run", "hit", "hit"]
    assert [o["ran"] for o in e.run()] == [True, True, False]


def test_tampering_and_loss_are_told_apart(spark, tmp_path):
    e = Engine(spark, Chain, str(tmp_path / "out"), {"n": 10, "title": "x"})
    e.run()
    path = e.store.read("stages", "numbers")["artifacts"][0]["path"]
    spark.range(3).write.mode("overwrite").parquet(path)
    own, consumer, _ = e.probe()
    assert (own["status"], own["reason"]) == ("needs-run", "artifact-changed")
    assert consumer["reason"] == "upstream 'numbers' changed"
    e.clean("numbers")
    assert e.probe()[0]["reason"] == "no-cache"


def test_failed_batch_resumes_valid_checkpoints(spark, tmp_path):
    e = Engine(spark, Batches, str(tmp_path / "out"))
    Batches.fail_at = 2
    with pytest.raises(RuntimeError):
        e.run()
    assert statuses(e)[0] == "failed"
    Batches.fail_at = None
    key = e.probe()[0]["key"]
    lost = e.store.partial("parts", key)[1]["artifacts"][0]["path"]
    for f in __import__("pathlib").Path(lost).glob("part-*"):
        f.unlink()
    assert sorted(e.probe()[0]["partial"]) == [0]
    e.run()
    record = e.store.read("stages", "parts")
    assert [a["name"].split("/")[0] for a in record["artifacts"]] == ["0", "1", "2", "3"]
    assert spark.read.parquet(e.store.read("stages", "whole")["artifacts"][0]["path"]).count() == 10


def test_matrix_cells_are_aligned_and_fanned_in(spark, tmp_path):
    e = Engine(spark, Matrix, str(tmp_path / "out"))
    e.run()
    done = spark.read.parquet(e.store.read("stages", "finish")["artifacts"][0]["path"]).orderBy("position").collect()
    assert [(r.bench, r.model) for r in done] == [("a", "small"), ("a", "large"), ("b", "small"), ("b", "large")]
    with pytest.raises(Blocked):
        Engine(spark, Matrix, str(tmp_path / "new")).run(only=["finish"])
    groups = {r.base: (r.status, r.cells) for r in e.status().collect()}
    assert groups == {"source": ("hit", 2), "score": ("hit", 4), "finish": ("hit", 1)}


def test_selectors():
    g = Graph(Matrix)
    assert g.resolve("score@model=large") == ["score@bench=a,model=large", "score@bench=b,model=large"]
    assert set(g.select(upto=["score@bench=a,model=small"])) == {"source@bench=a", "score@bench=a,model=small"}
    assert set(g.select(slices={"model": ["small"], "bench": ["b"]})) == {"source@bench=b", "score@bench=b,model=small"}
    for bad in ("scor", "score@model", "score@model=large,model=small", "score@other=1", "score@model=huge", "finish@model=large"):
        with pytest.raises(ValueError):
            g.resolve(bad)
    with pytest.raises(ValueError, match="did you mean"):
        g.resolve("scor")
    with pytest.raises(ValueError, match="not active"):
        Graph(Matrix, {"model": ["small"]}).resolve("score@model=large")
    assert Graph(Matrix, {"bench": ["b", "a"]}).domains["bench"] == ["a", "b"]


def test_review_gate(spark, tmp_path):
    helper = tmp_path / "helper.py"
    helper.write_text("x = 1\n")

    class Reviewed(Pipeline):
        depends = Dependencies(review_sources=(str(helper),))

        @stage()
        def one(ctx):
            return ctx.spark.range(2)

    e = Engine(spark, Reviewed, str(tmp_path / "out"))
    e.run()
    helper.write_text("# a comment\nx = 1\n")
    assert statuses(e) == ["hit"]
    helper.write_text("x = 2\n")
    assert statuses(e) == ["needs-review"]
    with pytest.raises(PendingReview):
        e.run()
    assert e.review("reuse") == {"one": "recorded"}
    assert e.review("reuse") == {"one": "already-decided"}
    assert statuses(e) == ["hit"]
    assert e.review("invalidate") == {"one": "recorded"}
    assert [o["ran"] for o in e.run()] == [True]
    assert e.review("reuse") == {"one": "not-needed"}


def test_store(tmp_path):
    s = Store(str(tmp_path / "p" / "main"))
    s.initialize("p")
    with s.lock(), pytest.raises(StoreLocked), Store(str(s.root)).lock():
        pass
    with pytest.raises(ValueError):
        s.initialize("q")
    s.write({"a": 1}, "stages", "x")
    assert s.read("stages", "x")["a"] == 1
    (s.root / "stages" / "x.json").write_text('{"schema": 0}')
    assert s.read("stages", "x") is None
    (s.root / "stages" / "x.json").write_text("{")
    with pytest.raises(CorruptStore):
        s.read("stages", "x")
    assert [d["branch"] for d in discover(str(tmp_path))] == ["main"]


def test_stream_takes_new_files_once(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(5).write.parquet(source)
    assert append_new(spark, source, target, check) == 1
    assert append_new(spark, source, target, check) == 0
    spark.range(5, 8).write.mode("append").parquet(source)
    append_new(spark, source, target, check)
    assert spark.read.parquet(target).count() == 8


class Async(Pipeline):
    @stage()
    async def first(ctx):
        return ctx.spark.range(2)

    @batch_stage(needs=first)
    async def many(ctx):
        for i in ctx.resume([1, 2]):
            yield ctx.spark.range(i)


def test_async_bodies_and_renewed_listings(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("x")

    class Reads(Async):
        depends = Dependencies(inputs={"src": str(source)})

    e = Engine(spark, Reads, str(tmp_path / "out"))
    assert [o["ran"] for o in e.run()] == [True, True]
    artifact = e.store.read("stages", "first")["artifacts"][0]
    spark.range(2).repartition(3).write.mode("overwrite").parquet(artifact["path"])
    assert [o["ran"] for o in e.run()] == [False, False]
    assert e.store.read("stages", "first")["artifacts"][0]["listing"] != artifact["listing"]
    source.write_text("y")
    assert statuses(e) == ["needs-run", "needs-run"]
    assert e.probe()[0]["reason"].startswith("input: src")


def test_digest_on_the_way_equals_the_stored_one(spark, tmp_path):
    from stageledger.plans.engine import _write, fingerprint

    frames = [
        spark.range(100).selectExpr("id", "cast(id as string) s", "if(id % 3 = 0, null, id / 7.0) d", "map('k', id) m", "array(id, null) a", "struct(id, 'x' as y) t", "timestamp_micros(id) ts", "date_add(date'2020-01-01', cast(id as int)) dt"),
        spark.createDataFrame([], "a int"),
        spark.range(10).repartition(3).groupBy((F.col("id") % 2).alias("k")).count(),
    ]
    for i, df in enumerate(frames):
        made = _write(spark, df, str(tmp_path / str(i)), "x")
        assert made["fingerprint"] == fingerprint(spark.read.parquet(made["path"]))


def test_a_run_reads_each_record_once(spark, tmp_path, monkeypatch):
    from stageledger.plans import engine as module

    e = Engine(spark, Chain, str(tmp_path / "out"), {"n": 10, "title": "x"})
    e.run()
    reads, probes, prints, read, probe, current = Counter(), [], Counter(), Store.read, Engine.probe, module._current
    monkeypatch.setattr(Store, "read", lambda self, kind, *names: reads.update([(kind, names)]) or read(self, kind, *names))
    monkeypatch.setattr(Engine, "probe", lambda self, *a, **k: probes.append(a) or probe(self, *a, **k))
    monkeypatch.setattr(module, "_current", lambda spark, a, rehash: prints.update([a["path"]]) or current(spark, a, rehash))
    assert [o["ran"] for o in e.run()] == [False] * 3
    assert len(probes) == 1 and all(reads["stages", (n,)] == 1 for n in ("numbers", "small", "report")) and set(prints.values()) == {1}
    probes.clear()
    e.config = {"n": 20, "title": "x"}
    assert [o["ran"] for o in e.run()] == [True, True, False]
    assert len(probes) == 3  # only stages below one that ran are decided again


def test_reasons_of_an_execution(spark, tmp_path):
    e = Engine(spark, Batches, str(tmp_path / "out"))
    Batches.fail_at = 2
    for _ in range(2):
        with pytest.raises(RuntimeError):
            e.run()
    assert e.probe()[0]["action_reason"] == "resume-after-failure"
    assert [(r.done, r.total, r.progress) for r in e.progress().collect()] == [(2, 4, "2/4")]
    Batches.fail_at = 0
    e.store.drop_partial("parts")
    with pytest.raises(RuntimeError):
        e.run()
    Batches.fail_at = None
    assert [(o["status"], o["reason"]) for o in e.run()] == [("needs-run", "retry-failed"), ("needs-run", "no-cache")]
    assert [o["reason"] for o in e.run(force=True)] == ["forced", "forced"]


class Takes(Pipeline):
    depends = Dependencies(review_sources=("HELPER",))
    fail_at = None

    @batch_stage()
    def parts(ctx):
        for i in ctx.resume(range(3)):
            if i == Takes.fail_at:
                raise RuntimeError("stop")
            yield ctx.spark.range(ctx.config["n"] + i)


def test_checkpoints_of_a_reused_source_are_adopted(spark, tmp_path, monkeypatch):
    helper = tmp_path / "helper.py"
    helper.write_text("x = 1\n")
    monkeypatch.setattr(Takes, "depends", Dependencies(review_sources=(str(helper),)))
    root = str(tmp_path / "out")
    Engine(spark, Takes, root, {"n": 1, "other": 1}).run()
    e = Engine(spark, Takes, root, {"n": 2, "other": 1})
    Takes.fail_at = 2
    with pytest.raises(RuntimeError):
        e.run()  # two checkpoints under the key of the fields that were read
    projected = e.probe()[0]
    assert sorted(projected["partial"]) == [0, 1] and projected["parts"]["config"] == {"n": 2}
    helper.write_text("x = 2\n")
    assert e.probe()[0]["status"] == "needs-review"
    e.review("reuse")
    made, Takes.fail_at = [], None
    monkeypatch.setattr(Store, "fresh", lambda self, n, fresh=Store.fresh: made.append(n) or fresh(self, n))
    assert [o["ran"] for o in e.run()] == [True]
    record = e.store.read("stages", "parts")
    assert len(made) == 1 and len(record["artifacts"]) == 3 and [spark.read.parquet(a["path"]).count() for a in record["artifacts"]] == [2, 3, 4]


def test_unreadable_artifacts_are_not_the_stages_failure(spark, tmp_path, monkeypatch):
    from stageledger.plans import engine as module

    e = Engine(spark, Chain, str(tmp_path / "out"), {"n": 10, "title": "x"})
    monkeypatch.setattr(module, "listing", lambda path: 1 / 0)
    with pytest.raises(module.Unfingerprinted):
        e.run()
    monkeypatch.undo()
    assert e.store.read("failures", "numbers") is None and e.probe()[0]["reason"] == "interrupted"


def test_another_schema_is_a_migration(spark, tmp_path):
    e = Engine(spark, Chain, str(tmp_path / "out"), {"n": 10, "title": "x"})
    e.run()
    for path in [e.store.root / "manifest.json", *(e.store.root / "stages").glob("*.json")]:
        path.write_text(json.dumps(json.loads(path.read_text()) | {"schema": 0}))
    e.store.write({"review": "x", "decision": "reuse"}, "reviews", "small")
    assert {p["reason"] for p in e.probe()} == {"schema-migration"}
    assert [o["ran"] for o in e.run()] == [True] * 3
    assert e.store.read("reviews", "small") is None and statuses(e) == ["hit"] * 3


def test_a_temporary_root_is_claimed_for_its_config(spark, tmp_path):
    claim = {"config": {"n": 1}, "axes": {}}
    s = Store(str(tmp_path / "t"))
    s.initialize("p", claim)
    s.initialize("p", claim)
    s.initialize("p")
    assert s.manifest()["temporary"] == claim
    with pytest.raises(ValueError, match="temporary"):
        s.initialize("p", {"config": {"n": 2}, "axes": {}})


class Size(enum.Enum):
    small = "s"
    large = "l"


@dataclasses.dataclass
class Inner:
    depth: int = 1


@dataclasses.dataclass
class Typed:
    rate: float
    size: Size = Size.small
    mode: Literal["fast", "slow"] = "fast"
    names: list[str] = dataclasses.field(default_factory=list)
    inner: Inner = dataclasses.field(default_factory=Inner)
    limit: int | None = None


def test_typed_configs(spark, tmp_path):
    from stageledger.functions.typed import build

    assert build(Typed, {"rate": 1, "size": "l", "inner": {"depth": 3}, "limit": None}) == Typed(1.0, Size.large, inner=Inner(3))
    for bad, match in [({}, "missing field rate"), ({"rate": 1, "more": 2}, "unknown field more"), ({"rate": "x"}, "rate: not float"), ({"rate": 1, "inner": {"depth": True}}, "inner.depth"), ({"rate": 1, "size": "m"}, "size"), ({"rate": 1, "mode": "x"}, "mode"), ({"rate": 1, "names": "x"}, "names: not a list")]:
        with pytest.raises(ValueError, match=match):
            build(Typed, bad)

    class Uses(Pipeline):
        Config = Typed

        @stage()
        def one(ctx):
            return ctx.spark.range(ctx.config.inner.depth)

    e = Engine(spark, Uses, str(tmp_path / "out"), {"rate": 2, "inner": {"depth": 4}})
    e.run()
    assert e.store.read("stages", "one")["access"] == ["inner"]
    assert statuses(Engine(spark, Uses, str(tmp_path / "out"), {"rate": 3, "inner": {"depth": 4}})) == ["hit"]


def test_signatures_of_cells():
    class Bad(Pipeline):
        @matrix(BENCH)
        @stage()
        def one(ctx, model):
            return None

    class Plain(Pipeline):
        @stage()
        def one(ctx, extra):
            return None

    for pipeline in (Bad, Plain):
        with pytest.raises(TypeError, match="exactly its axes"):
            Graph(pipeline)


def _jobs(spark, group, act):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        found = act()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return found, len(sc.statusTracker().getJobIdsForGroup(group))


def _wide(cells):
    class Wide(Pipeline):
        @matrix(Axis("cell", [f"c{i:04d}" for i in range(cells)]))
        @stage()
        def part(ctx, cell):
            return ctx.spark.range(1)

        @stage(needs=part)
        def whole(ctx):
            return ctx.union("part")

    return Wide


def test_a_probe_is_one_plan_whatever_the_cells(spark, tmp_path):
    """1,000 cells with records take as many Spark jobs as 10, and each is judged on its own."""
    jobs = {}
    for cells in (10, 1000):
        root = tmp_path / f"out{cells}"
        e = Engine(spark, _wide(cells), str(root), {"n": 1})
        first = e.probe()
        assert len(first) == cells + 1 and {p["reason"] for p in first} == {"no-cache"}
        e.store.initialize(e.name)
        for i, p in enumerate(first[:-1]):
            key, parts = (p["key"], p["parts"]) if i % 5 else ("sha256:other", p["parts"] | {"config": {"n": i}})
            e.store.write({"key": key, "parts": parts, "access": None, "rerun": p["rerun"], "review": p["review_fingerprint"], "artifacts": [], "elapsed": 1.0, "at": "now"}, "stages", p["stage"])
        found, jobs[cells] = _jobs(spark, f"probe-{cells}", e.probe)
        assert [p["status"] for p in found[:-1]] == ["hit" if i % 5 else "needs-run" for i in range(cells)]
        assert found[5]["reason"] == "config: n 5 -> 1" and found[-1]["status"] == "needs-run"
    assert jobs[1000] <= jobs[10] + 1, jobs
