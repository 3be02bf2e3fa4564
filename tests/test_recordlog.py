import json
import random

import pytest

from stageledger.sources.recordlog import Conflict, RecordLog


def state(log, as_of=None):
    return {(r.kind, r.name): json.loads(r.body) for r in log.state(as_of).collect()}


def test_latest_wins_as_of_any_commit(spark, tmp_path):
    """Random writes, removals and snapshots against a dictionary for each sequence."""
    rng, log, now, then = random.Random(2), RecordLog(spark, str(tmp_path / "log")), {}, {0: {}}
    for i in range(12):
        if i in (5, 9):
            sequence = log.compact()
        else:
            change = {("stage", f"s{rng.randrange(5)}"): rng.choice([None, {"v": i}, {"v": "é", "n": [1, None]}]) for _ in range(3)} | {("review", "r"): {"at": i}}
            sequence = log.write(change)
            now = {k: v for k, v in (now | change).items() if v is not None}
        then[sequence] = dict(now)
    assert sorted(then) == list(range(13)) and log.sequence() == 12
    for s in (0, 1, 4, 5, 6, 7, 10, 12):
        assert state(log, s) == then[s], s
    assert {r.sequence for r in log.history().where("kind = 'review'").collect()} == set(range(1, 13)) - {6, 10}
    assert log.vacuum(11) == list(range(1, 10)) and state(log) == then[12] and state(log, 11) == then[11]
    assert len(log.commits()) == 3


def test_a_crash_before_the_marker_leaves_the_old_state(spark, tmp_path, monkeypatch):
    log = RecordLog(spark, str(tmp_path / "log"))
    log.write({("stage", "a"): {"v": 1}})
    with monkeypatch.context() as m:
        m.setattr(RecordLog, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        for step in (lambda: log.write({("stage", "a"): {"v": 2}}), log.compact):
            with pytest.raises(KeyboardInterrupt):
                step()
    assert state(log) == {("stage", "a"): {"v": 1}} and log.sequence() == 1
    log.write({("stage", "a"): {"v": 3}})
    assert state(log) == {("stage", "a"): {"v": 3}} and state(log, 1) == {("stage", "a"): {"v": 1}}
    log.vacuum(0)  # what the crashes left
    assert len(list((tmp_path / "log" / "data").iterdir())) == 2 and state(log) == {("stage", "a"): {"v": 3}}


def test_two_writers(spark, tmp_path):
    one, other = RecordLog(spark, str(tmp_path / "log")), RecordLog(spark, str(tmp_path / "log"))
    read = one.sequence()
    one.write({("stage", "a"): 1}, expected=read)
    with pytest.raises(Conflict):
        other.write({("stage", "a"): 2}, expected=read)
    other.write({("stage", "b"): 2})
    assert state(one) == {("stage", "a"): 1, ("stage", "b"): 2}


def test_a_record_twice_in_a_commit(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    with pytest.raises(ValueError, match="twice"):
        log.append(spark.createDataFrame([("stage", "a", "1"), ("stage", "a", "2")], "kind string, name string, body string"))
    assert log.state().collect() == []
