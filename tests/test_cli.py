import dataclasses
import json

import pytest

from stageledger import Pipeline, stage
from stageledger.cli import main, shorten, table
from stageledger.functions import branches
from stageledger.functions.config_access import RecordingConfig, merge


class Small(Pipeline):
    config = {"n": 3}

    @stage()
    def one(ctx):
        return ctx.spark.range(ctx.config["n"])

    @stage(needs=one)
    def two(ctx):
        return ctx.input("one")


def test_commands(spark, tmp_path, capsys):
    out, name = ["--out", str(tmp_path)], f"{__name__}:Small"
    assert main([name, "status", *out], spark) == 1
    assert main([name, "run", *out], spark) == 0
    assert main([name, "status", *out], spark) == 0
    capsys.readouterr()
    assert main([name, "ls", *out], spark) == 0
    assert capsys.readouterr().out.splitlines()[1] == "two\tsingle\tone\t-"
    assert main([name, "plan", "two", *out], spark) == 0
    assert "two\thit\t<- one" in capsys.readouterr().out
    assert main([name, "run", "--config", '{"n": 5}', *out], spark) == 0
    assert main([name, "reuse", *out], spark) == 0
    assert main(["stores", str(tmp_path)]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) >= 2
    assert main([name, "clean", "one", "--downstream", *out], spark) == 0
    assert main([name, "status", *out], spark) == 1
    assert main([name, "run", "tow", *out], spark) == 1


def test_branches(tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"dev": {"config": {"a": {"x": None}}, "axes": {"m": ["s"]}}}))
    known = branches.load(str(path))
    defaults = {"a": {"x": 1, "y": 2}, "b": 3}
    dev = branches.resolve("out", defaults, known, "dev", env={"b": 4})
    assert dev.config == {"a": {"x": None, "y": 2}, "b": 4} and dev.axes == {"m": ["s"]} and dev.root == "out/dev"
    over = branches.resolve("out", defaults, known, "dev", override={"b": "é"})
    assert over.root == f"out/tmp/{over.name}" and over.name == branches.override_name(over.config, over.axes)
    path.write_text('{"dev": {"other": 1}}')
    with pytest.raises(ValueError):
        branches.load(str(path))
    for bad in ("", "a/b", "..", ".tmp"):
        with pytest.raises(ValueError):
            branches.check_name(bad)
    assert branches.from_environment("small", {"SMALL__N": "7", "SMALL__A__B": "x", "OTHER__N": "1"}) == {"n": 7, "a": {"b": "x"}}


def test_config_reads():
    c = RecordingConfig({"a": 1, "b": 2})
    assert (c.a, c["b"]) == (1, 2) and c.recorded() == ["a", "b"]
    c = RecordingConfig({"a": 1})
    __import__("pickle").dumps(c)
    assert c.recorded() is None
    assert merge(["a"], ["b"], True, True) == ["a", "b"]
    assert merge(["a"], None, True, True) is None and merge(["a"], ["b"], True, False) == ["a"] and merge(None, ["b"], True, True) is None


@dataclasses.dataclass
class Deep:
    rows: int = 1


@dataclasses.dataclass
class SmallArgs:
    fast: bool = False
    seed: int | None = 1
    deep: Deep = dataclasses.field(default_factory=Deep)


class WithArgs(Pipeline):
    Args = SmallArgs
    seen = []

    @stage()
    def one(ctx):
        WithArgs.seen.append(ctx.args)
        return ctx.spark.range(ctx.args.deep.rows)


def test_typed_flags(spark, tmp_path, capsys):
    out, name = ["--out", str(tmp_path)], f"{__name__}:WithArgs"
    assert main([name, "run", *out, "--fast", "--seed", "null", "--deep.rows", "3"], spark) == 0
    assert WithArgs.seen == [SmallArgs(True, None, Deep(3))]
    assert main([name, "run", *out, "--force", "--no-fast", "--args", '{"seed": 7}'], spark) == 0
    assert WithArgs.seen[1:] == [SmallArgs(False, 7)]
    assert main([name, "run", *out, "--force", "--args", '{"sed": 7}'], spark) == 1
    with pytest.raises(SystemExit):
        main([name, "run", *out, "--deep.rows", "x"], spark)


def test_many_stores(spark, tmp_path, capsys):
    out = ["--out", str(tmp_path)]
    assert main([f"{__name__}:Small", "run", *out], spark) == 0
    assert main([f"{__name__}:Small", "run", "--config", '{"n": 5}', *out], spark) == 0
    capsys.readouterr()
    assert main(["stores", str(tmp_path), "status"], spark) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 1
    assert main(["stores", str(tmp_path), "status", "--include-temp"], spark) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    assert main([f"{__name__}:Small", "clean", "two", *out], spark) == 0
    assert main(["stores", str(tmp_path), "status", "--include-temp"], spark) == 1
    assert main(["stores", str(tmp_path), "reuse", "--status", "needs-run"], spark) == 0
    assert "unchanged=2" in capsys.readouterr().out
    assert main(["stores", str(tmp_path), "run", "--include-temp"], spark) == 0
    assert main(["stores", str(tmp_path), "status", "--include-temp"], spark) == 0
    assert main(["stores", str(tmp_path), "status", "--module-prefix", "nothing"], spark) == 0
    assert main(["stores", str(tmp_path), "dance"], spark) == 1


def test_rendering():
    assert shorten("short") == "short"
    assert shorten("a_name_with_many-parts_of_some_length", 12) == "a_name_with_\nmany-parts_\nof_some_\nlength"
    assert shorten("x" * 40, 11) == "xxxxx…xxxxx"
    assert table([("a\nb", "1"), ("ccc", "22")]) == "a    1\nb\nccc  22"
