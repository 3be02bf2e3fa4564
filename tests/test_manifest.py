import os

import pytest
from pyspark.sql import functions as F

from stageledger.sources import manifest


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def taken(spark, root, cache=None):
    cache = spark.createDataFrame([], manifest.CACHE) if cache is None else cache
    entries, fresh = manifest.hashed(manifest.listed(spark, root), cache)
    return manifest.digest(entries), fresh, {(r.name, r.kind): r.content_hash for r in entries.collect()}


@pytest.mark.parametrize("budget", [20_000, 7])
def test_a_tree_is_listed_and_hashed_in_tasks(spark, tmp_path, monkeypatch, budget):
    monkeypatch.setattr(manifest, "BUDGET", budget)
    root = tree(tmp_path / "in", {f"d{i % 5}/e{i % 3}/f{i}.txt": f"text {i}" for i in range(60)} | {"top.txt": "é"})
    os.makedirs(os.path.join(root, "hollow/below"))
    import hashlib

    _, fresh, found = taken(spark, root)
    expected = {(".", "dir"): None}
    for folder, below, files in os.walk(root):
        at = os.path.relpath(folder, root)
        for n in below:
            expected[os.path.normpath(os.path.join(at, n)), "dir"] = None
        for n in files:
            with open(os.path.join(folder, n), "rb") as f:
                expected[os.path.normpath(os.path.join(at, n)), "file"] = f"sha256:{hashlib.sha256(f.read()).hexdigest()}"
    assert found == expected and fresh.count() == 61


def test_only_what_changed_is_read(spark, tmp_path):
    root = tree(tmp_path / "in", {f"{i % 7}/f{i}": "x" * i for i in range(300)})
    one, fresh, _ = taken(spark, root)
    assert fresh.count() == 300
    cache = fresh
    os.chmod(tmp_path / "in" / "0/f0", 0o600)
    two, fresh, _ = taken(spark, root, cache)
    assert two == one and fresh.count() == 0
    (tmp_path / "in" / "3/f3").write_text("other")
    three, fresh, _ = taken(spark, root, cache)
    assert three != one and [os.path.basename(r.path) for r in fresh.collect()] == ["f3"]
    # The same content elsewhere is the same digest; another name or an empty folder isn't.
    again, _, _ = taken(spark, tree(tmp_path / "copy", {f"{i % 7}/f{i}": "x" * i for i in range(300)}))
    assert again == one
    (tmp_path / "copy" / "hollow").mkdir()
    assert taken(spark, str(tmp_path / "copy"))[0] != one


def test_single_files_links_and_absence(spark, tmp_path):
    root = tree(tmp_path, {"a.txt": "a", "in/b.txt": "b"})
    assert taken(spark, f"{root}/a.txt")[2] == {(".", "file"): "sha256:ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"}
    with pytest.raises(FileNotFoundError, match="gone"):
        manifest.listed(spark, f"{root}/gone")
    os.symlink(f"{root}/a.txt", tmp_path / "in" / "link")
    with pytest.raises(ValueError, match="link: .*/in/link"):
        manifest.listed(spark, f"{root}/in")
    assert manifest.listed(spark, f"file://{root}/a.txt").select(F.col("name")).collect()[0].name == "."
