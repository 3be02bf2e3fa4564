import copy
import dataclasses
import importlib.util
import os
import pickle
from pathlib import Path

import pytest

from stageledger.functions import source_code as sc
from stageledger.functions.config_access import RecordingConfig

COUNT = iter(range(10**6))


def loaded(path):
    spec = importlib.util.spec_from_file_location(f"loaded_{next(COUNT)}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    module.__name__ = "loaded"
    return module


def observed(path, *names, sources=(), review=()):
    """Observations of the named stages of a fresh import of ``path``, all of them staged."""
    module = loaded(path)
    funcs = []
    for name in names:
        f = module
        for part in name.split("."):
            f = getattr(f, part)
        f.__module__ = "loaded"
        funcs.append(f)
    return [sc.observe(f, funcs, tuple(map(str, sources)), tuple(map(str, review))) for f in funcs]


TWO = """
HELPER = 1

def build():
    return HELPER

class Demo:
    def build(ctx):
        # a comment
        return build()

    def other(ctx, x=1):
        return 2
"""


def test_a_helper_with_a_stages_name_asks(tmp_path):
    path = tmp_path / "m.py"
    path.write_text(TWO)
    first = observed(path, "Demo.build", "Demo.other")
    path.write_text(TWO.replace("return HELPER", "return HELPER + 1"))
    second = observed(path, "Demo.build", "Demo.other")
    for (rerun, review), (rerun2, review2) in zip(first, second, strict=True):
        assert rerun == rerun2 and review != review2


def test_a_stages_own_body_reruns_it_alone(tmp_path):
    path = tmp_path / "m.py"
    path.write_text(TWO)
    first = observed(path, "Demo.build", "Demo.other")
    for old, new, changed in [("# a comment", "# another", (False, False)), ("return 2", "return 3", (False, True)), ("x=1", "x=2", (False, True)), ("    def build(ctx):", "    @staticmethod\n    def build(ctx):", (True, False))]:
        path.write_text(TWO.replace(old, new))
        second = observed(path, "Demo.build", "Demo.other")
        assert tuple(a[0] != b[0] for a, b in zip(first, second, strict=True)) == changed, old
        assert all(a[1] == b[1] for a, b in zip(first, second, strict=True)), old


def test_overlapping_files_are_the_rerun_policys(tmp_path):
    path, shared = tmp_path / "m.py", tmp_path / "shared"
    shared.mkdir()
    path.write_text(TWO)
    (shared / "member.py").write_text("VALUE = 1\n")
    (shared / "more.py").write_text("MORE = 1\n")
    both = lambda: observed(path, "Demo.build", sources=[shared], review=[shared / "member.py"])[0]
    other = lambda: observed(path, "Demo.build", sources=[shared / "member.py"], review=[shared])[0]
    a, b = both(), other()
    (shared / "member.py").write_text("VALUE = 2\n")
    assert both()[0] != a[0] and both()[1] == a[1]
    assert other()[0] != b[0] and other()[1] == b[1]
    (shared / "more.py").write_text("MORE = 2\n")
    assert other()[1] != b[1]
    with pytest.raises(ValueError, match="two policies"):
        observed(path, "Demo.build", sources=[shared], review=[f"{shared}/../shared"])


def test_what_is_not_one_function_is_an_error(tmp_path):
    path = tmp_path / "m.py"
    path.write_text("def make():\n    def build(ctx): return 1\n    if True:\n        def build(ctx): return 2\n    return build\n\nbuild = make()\ntwice = [lambda ctx: 1, lambda ctx: 2][0]\nexec('def made(ctx): return 1')\n")
    assert observed(path, "build")  # two of a name, told apart by their lines
    for name in ("twice", "made"):
        with pytest.raises((ValueError, OSError, TypeError)):
            observed(path, name)


def test_encodings_and_racing_writes(tmp_path, monkeypatch):
    path = tmp_path / "m.py"
    path.write_bytes("# coding: latin-1\ndef build(ctx):\n    return 'é'\n".encode("latin-1"))
    assert observed(path, "build")
    path.write_text(TWO)
    before = observed(path, "Demo.build")[0]
    func, reads, read = loaded(path).Demo.build, [], Path.read_bytes
    func.__module__ = "loaded"

    def racing(p):
        data = read(p)
        if p == path.resolve():
            reads.append(p)
            if len(reads) == 1:
                path.write_text(TWO.replace("HELPER = 1", "HELPER = 22"))
        return data

    monkeypatch.setattr(Path, "read_bytes", racing)
    assert sc.observe(func, [func], (), ())[1] != before[1] and len(reads) == 2
    monkeypatch.setattr(Path, "read_bytes", lambda p: os.utime(p, ns=(next(COUNT), next(COUNT))) or read(p))
    with pytest.raises(RuntimeError, match="changes while"):
        sc.observe(func, [func], (), ())


def test_reads_that_cannot_be_told_apart_latch_all():
    reads = {
        "unknown": lambda c: getattr(c, "nope", None),
        "unknown item": lambda c: c.get("nope"),
        "dict": lambda c: c.__dict__,
        "items": lambda c: list(c.items()),
        "iteration": lambda c: dict(c),
        "length": len,
        "membership": lambda c: "a" in c,
        "pickle": lambda c: pickle.loads(pickle.dumps(c)),
        "text": str,
    }
    for name, read in reads.items():
        c = RecordingConfig({"a": {"x": 1, "y": 2}, "b": 2})
        assert c.a["x"] + getattr(c, "b") == 3 and c.recorded() == ["a", "b"]
        read(c)
        assert c.recorded() is None, name
    with pytest.raises(AttributeError):
        c.a = 2


@dataclasses.dataclass(frozen=True)
class Sized:
    width: int = 2
    height: int = 3
    name: str = "box"

    @property
    def area(self):
        return self.width * self.height

    def scaled(self, by):
        return dataclasses.replace(self, width=self.width * by)


def test_typed_configs_keep_their_own():
    one = RecordingConfig(Sized())
    assert one.width == 2 and one["height"] == 3 and one.recorded() == ["height", "width"]
    assert one.area == 6 and one.recorded() is None
    other = RecordingConfig(Sized())
    assert other.scaled(4).width == 8 and other.recorded() is None
    for read in (pickle.loads(pickle.dumps(RecordingConfig(Sized()))), copy.deepcopy(RecordingConfig(Sized()))):
        assert isinstance(read, Sized) and read.area == 6
    assert RecordingConfig(Sized()) == Sized() and repr(RecordingConfig(Sized())) == repr(Sized())
    assert isinstance(pickle.loads(pickle.dumps(RecordingConfig({"a": 1}))), dict)
    with pytest.raises(AttributeError):
        RecordingConfig(Sized()).depth
