import pytest

from stageledger import Pipeline, stage
from stageledger.plans.bulk import overview, review_all, run_all
from stageledger.plans.engine import Engine


class Good(Pipeline):
    @stage()
    def one(ctx):
        return ctx.spark.range(2)


class Bad(Pipeline):
    @stage()
    def one(ctx):
        raise RuntimeError("no")


def test_one_failing_store_does_not_stop_the_rest(spark, tmp_path):
    engines = [Engine(spark, Bad, str(tmp_path / "bad")), Engine(spark, Good, str(tmp_path / "good"))]
    with pytest.warns(UserWarning, match="bad: RuntimeError: no"):
        assert run_all(engines) == 1
    assert run_all([]) == 1
    rows = {r.store.rsplit("/", 1)[1]: (r.status, r.complete) for r in overview(spark, engines).collect()}
    assert rows == {"bad": ("failed", False), "good": ("hit", True)}
    assert run_all(engines[1:]) == 0
    assert review_all([*engines, Engine(spark, Good, str(tmp_path / "none"))], "reuse")["failed"] == 1
