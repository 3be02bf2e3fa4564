"""A log of records: appended Parquet, latest wins, readable as of any commit.

A commit is a folder of Parquet files and, after it, one small marker under ``_commits``
that names it. Markers are numbered; a marker is made only if none of its number is there,
so of two writers at one number one fails and may try the next. What has no marker isn't
there: a writer that dies between its data and its marker leaves the state as it was.

``compact`` writes the state as a commit of its own, a snapshot: readers start from the
last snapshot at or before the sequence that they ask for. Nothing older goes until
``vacuum`` is asked to.

All files are reached through Hadoop's file systems, by the driver for markers and by
Spark for data. A store whose exclusive creation isn't atomic needs a lock besides.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import latest

#: ``body`` is canonical JSON; null takes the record away.
RECORDS = "kind string, name string, body string"
SCHEMA = f"{RECORDS}, sequence long"


class Conflict(RuntimeError):
    """Another writer made this commit first."""


class RecordLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # Markers

    def commits(self) -> list[dict[str, Any]]:
        """sequence, folder, snapshot and rows of each commit, in order."""
        folder = self._of(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        found = [self._marker(s.getPath()) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
        return sorted(found, key=lambda c: c["sequence"])

    def _marker(self, path: Any) -> dict[str, Any]:
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, sequence: int, folder: str, snapshot: bool) -> int:
        """The marker is written beside its place and renamed, so that it's whole or not there."""
        target, part = self._of(f"{self.path}/_commits/{sequence:012d}.json"), self._of(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps({"sequence": sequence, "folder": folder, "snapshot": snapshot}).encode()))
        stream.close()
        # On local and Hadoop file systems a rename onto a file that is there is refused.
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise Conflict(f"commit {sequence} of {self.path} is taken")
        return sequence

    # Writing

    def append(self, records: DataFrame, expected: int | None = None) -> int:
        """Commit rows of ``RECORDS``; returns the sequence.

        ``expected`` is the sequence that the writer has read: another commit since then is
        a conflict. Without it, the next free one is taken. Two rows of one record in one
        commit are an error.
        """
        folder = f"data/{uuid.uuid4().hex}"
        records.select("kind", "name", "body").write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(RECORDS).parquet(f"{self.path}/{folder}")
        if twice := written.groupBy("kind", "name").count().where("count > 1").head(1):
            raise ValueError(f"{twice[0].kind} {twice[0].name!r} is there twice")
        if expected is not None:
            return self._publish(expected + 1, folder, False)
        while True:
            try:
                return self._publish(self.sequence() + 1, folder, False)
            except Conflict:
                continue

    def write(self, records: dict[tuple[str, str], Any], expected: int | None = None) -> int:
        """Commit records by (kind, name); None takes one away."""
        rows = [(k, n, None if v is None else json.dumps(v, sort_keys=True, ensure_ascii=False)) for (k, n), v in records.items()]
        return self.append(self.spark.createDataFrame(rows, RECORDS).coalesce(1), expected)

    def sequence(self) -> int:
        """The last commit's, 0 before the first."""
        found = self.commits()
        return found[-1]["sequence"] if found else 0

    # Reading

    def history(self, as_of: int | None = None, whole: bool = True) -> DataFrame:
        """Every version of every record with its sequence; not ``whole``, from the last snapshot on."""
        found = [c for c in self.commits() if as_of is None or c["sequence"] <= as_of]
        if not whole:
            starts = [i for i, c in enumerate(found) if c["snapshot"]]
            found = found[starts[-1] :] if starts else found
        else:
            found = [c for i, c in enumerate(found) if not c["snapshot"] or not i]  # a snapshot repeats what came before
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        # One scan of all folders; a row's sequence is that of its folder.
        number = F.create_map(*[x for c in found for x in (F.lit(c["folder"].rpartition("/")[2]), F.lit(c["sequence"]).cast("long"))])
        rows = self.spark.read.schema(RECORDS).parquet(*[f"{self.path}/{c['folder']}" for c in found])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.select("kind", "name", "body", F.element_at(number, folder).alias("sequence"))

    def state(self, as_of: int | None = None, kind: str | None = None) -> DataFrame:
        """(kind, name, body, sequence): the latest version of each record that isn't taken away."""
        rows = self.history(as_of, whole=False)
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        return latest(rows, ["kind", "name"], ["sequence"]).where("body is not null").select("kind", "name", "body", "sequence")

    # Upkeep

    def compact(self) -> int:
        """The state as one commit that readers start from; a commit made meanwhile is a conflict."""
        last = self.sequence()
        folder = f"data/{uuid.uuid4().hex}"
        self.state(last).select("kind", "name", "body").write.parquet(f"{self.path}/{folder}")
        return self._publish(last + 1, folder, True)

    def vacuum(self, keep_from: int) -> list[int]:
        """Drop commits before the last snapshot at or before ``keep_from``, and data of no commit; sequences dropped.

        No writer may be at work: its data has no marker yet.
        """
        found = self.commits()
        starts = [i for i, c in enumerate(found) if c["snapshot"] and c["sequence"] <= keep_from]
        gone, kept = (found[: starts[-1]], found[starts[-1] :]) if starts else ([], found)
        for c in gone:
            self._fs.delete(self._of(f"{self.path}/_commits/{c['sequence']:012d}.json"), False)
        names = {c["folder"].rpartition("/")[2] for c in kept}
        data = self._of(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in names:
                self._fs.delete(s.getPath(), True)
        return [c["sequence"] for c in gone]
