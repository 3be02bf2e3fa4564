"""Filter interaction audit: the trie of all orders of some filters, walked depth first.

Each document's failures are measured once and written, a few bytes a row. The walk
starts from all documents; applying a filter to a state's persisted survivors gives the
next state. What survives doesn't depend on the order in which the same filters were
applied, so the states of the trie are memoised by their set of filters: 2 ** n instead
of the n! * e nodes of the full trie. At each state one aggregate over its survivors
counts, for every filter not yet applied, what that filter removes there: the edges.

An order's steps are edges, looked up by (state, filter); Shapley values are edges
weighted by how many orders pass them. Counts are the only thing that is joined: a row
per part, state and filter.

Defined cases: null texts are empty; a null source is the part ''; rows of one doc_id
are documents of their own; a row without doc_id is never a later copy and has no
labels; a document is good or toxic if any of its labels says so; an empty table has no
parts, hence no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table, words

#: Failure conditions by letter, over a row of :func:`measured`.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "marked",
    "E": "copied",
}
MARKS = "[#$%&*|]"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, key, n_chars, n_words, n_distinct, n_upper, marked: in one pass, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("_t"), words(F.col("text")).alias("_w"))
    return rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("_t", 256)).alias("key"),
        F.length("_t").cast("long").alias("n_chars"),
        F.size("_w").cast("long").alias("n_words"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.col("_t").rlike(MARKS).alias("marked"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """``copied``: whether a smaller doc_id has the same key, from a written table of keys that repeat."""
    least = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1").select("key", "_least"), "repeated-texts")
    return rows.join(least, "key", "left").withColumn("copied", F.coalesce(F.col("_least") < F.col("doc_id"), F.lit(False))).drop("_least")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


class Trie:
    """States by their set of filters, each with its survivors and its edges."""

    def __init__(self, failures: DataFrame, names: Iterable[str], by: str = "part", counts: dict[str, str] | None = None):
        self.names, self.by = list(names), by
        #: What else is summed of what an edge removes: name and Boolean column.
        self.counts = counts or {}
        self.root = failures
        self.edges: dict[frozenset[str], DataFrame] = {}

    def walk(self) -> DataFrame:
        """(part, state, filter, entered, removed, ...): every edge of the trie, counted where it is."""
        self._visit(frozenset(), self.root)
        return reduce(DataFrame.unionByName, self.edges.values())

    def _visit(self, state: frozenset[str], survivors: DataFrame) -> None:
        left = [f for f in self.names if f not in state]
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        self.edges[state] = self._counted(state, survivors, left)
        for f in left:
            if state | {f} not in self.edges and len(left) > 1:  # the last filter's survivors have no edges
                self._visit(state | {f}, survivors.where(~F.col(f)))
        survivors.unpersist()

    def _counted(self, state: frozenset[str], survivors: DataFrame, left: list[str]) -> DataFrame:
        """One job: what each filter of ``left`` would remove from the survivors."""
        sums = [F.count(F.lit(1)).alias("entered")]
        for f in left:
            sums.append(F.count_if(F.col(f)).alias(f"{f}_removed"))
            sums += [F.count_if(F.col(f) & F.col(c)).alias(f"{f}_{n}") for n, c in self.counts.items()]
        edge = [F.struct(F.lit(f).alias("filter"), *[F.col(f"{f}_{n}").alias(n) for n in ("removed", *self.counts)]) for f in left]
        found = survivors.groupBy(self.by).agg(*sums).select(self.by, F.lit("".join(sorted(state))).alias("state"), "entered", F.explode(F.array(*edge)).alias("e"))
        return materialize(found.select(self.by, "state", "entered", "e.*"), "trie-edges")

    def discard(self) -> None:
        for x in self.edges.values():
            discard(x)


def orders(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """(filter_order, step, filter, state): n * n! rows, whatever the input."""
    rows = [("".join(p), i + 1, f, "".join(sorted(p[:i]))) for p in permutations(names) for i, f in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, state string")


def shapley_weight(state: Column, n: int) -> Column:
    """Orders that pass an edge from this state: those of what came before, times those of what comes after."""
    return F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.length(state) + 1)


def audit(failures: DataFrame, names: Iterable[str], by: str = "part", counts: dict[str, str] | None = None) -> DataFrame:
    """One row per part, order and step. ``failures``: a written table with a Boolean column per filter."""
    names = list(names)
    trie = Trie(failures, names, by, counts)
    edges = materialize(trie.walk(), "edges")
    trie.discard()
    per_filter = edges.groupBy(by, "filter").agg(
        F.sum(F.when(F.col("state") == "", F.col("removed"))).alias("failing"),
        F.sum(F.when(F.length("state") == len(names) - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * shapley_weight(F.col("state"), len(names))).cast("long").alias("shapley"),
    )
    # n * n! steps are broadcast. A state that none of a part's rows reach has no edge: nothing enters it there.
    steps = F.broadcast(orders(failures.sparkSession, names))
    rows = per_filter.join(steps, "filter").join(edges, [by, "state", "filter"], "left").na.fill(0)
    kept, redundant = F.col("entered") - F.col("removed"), F.col("failing") - F.col("removed")
    return rows.select(by, "filter_order", "step", kept.alias("kept"), "removed", redundant.alias("redundant"), "unique_fails", *(counts or {}), "shapley")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and a Boolean for each of ``FILTERS``, written."""
    rows = materialize(measured(docs), "measured")
    judged = with_labels(with_copies(rows), labels).select("part", "good", "toxic", *[F.expr(e).alias(f) for f, e in FILTERS.items()])
    out = materialize(judged, "failures")
    discard(rows)
    return out


def op13_permutation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = audit(found, FILTERS, counts={"good_lost": "good", "toxic_lost": "toxic"})
    discard(found)
    return out


_WORDS = r"list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')"
ORACLE = f"""with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_WORDS} as w from documents),
 lab as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
 copies as (select t, min(doc_id) as least from d group by t),
 f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
   cast(len(w) < 50 as int) + 2 * cast(100 * len(list_distinct(w)) < 65 * len(w) as int) + 4 * cast(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) as int)
   + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(least < d.doc_id, false) as int) as mask
   from d left join lab on d.doc_id = lab.doc_id join copies using (t)),
 m as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, mask),
 bits(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 p(o, step, letter, bit, before) as (select letter, 1, letter, bit, 0 from bits union all select p.o || b.letter, p.step + 1, b.letter, b.bit, p.before + p.bit from p join bits b on not contains(p.o, b.letter)),
 steps as (select q.o as filter_order, p.step, p.letter, p.bit, p.before from p join p q on q.step = 5 and starts_with(q.o, p.o)),
 r as (select part, filter_order, step, letter, sum(n) filter ((mask & (before + bit)) = 0) as kept, sum(n) filter ((mask & before) = 0 and (mask & bit) > 0) as removed,
   sum(n) filter ((mask & before) > 0 and (mask & bit) > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
   sum(good) filter ((mask & before) = 0 and (mask & bit) > 0) as good_lost, sum(toxic) filter ((mask & before) = 0 and (mask & bit) > 0) as toxic_lost
   from m cross join steps group by part, filter_order, step, letter)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
 cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
 cast(sum(coalesce(removed, 0)) over (partition by part, letter) as bigint) as shapley from r"""
