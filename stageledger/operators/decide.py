"""The cache decision, its reasons and overlays, each as one expression over joined columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which difference explains an invalidation first.
PRIORITY = ["source", "config", "value", "input", "upstream"]


def decide(failed: Column, attempted: Column, partial: Column, success: Column, key_match: Column, missing: Column, mismatch: Column, reason: Column) -> Column:
    """(status, reason); failure and attempt marks go before a key match."""
    result = lambda status, why: F.struct(F.lit(status).alias("status"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    match = success & key_match
    return (
        F.when(failed, result("failed", "stage-failed"))
        .when(attempted & partial, result("resume", "resume"))
        .when(attempted, result("needs-run", "interrupted"))
        .when(match & missing, result("needs-run", "artifact-missing"))
        .when(match & mismatch, result("needs-run", "artifact-changed"))
        .when(match, result("hit", "hit"))
        .when(partial, result("resume", "resume"))
        .when(~success, result("needs-run", "no-cache"))
        .otherwise(result("needs-run", reason))
    )


def relationship(baseline: Column, current: Column) -> Column:
    return F.when(baseline.isNull(), "not-applicable").when(baseline == current, "current").otherwise("changed")


def effective(status: Column, relation: Column, decision: Column) -> Column:
    return F.when((relation != "changed") | (decision.isNotNull() & (decision == "reuse")), status).when(decision == "invalidate", "needs-run").otherwise("needs-review")


def effective_reason(reason: Column, relation: Column, decision: Column) -> Column:
    return F.when((relation != "changed") | (decision.isNotNull() & (decision == "reuse")), reason).otherwise("source-changed")


def overlay(status: Column, reason: Column, forced: Column, invalidated: Column, partial: Column) -> Column:
    """What an execution makes of a decision: force, invalidation, then failures."""
    result = lambda s, w: F.struct(s.alias("status"), w.alias("reason"))
    return (
        F.when(forced, result(F.lit("needs-run"), F.lit("forced")))
        .when(invalidated, result(F.lit("needs-run"), F.lit("source-changed")))
        .when((status == "failed") & partial, result(F.lit("resume"), F.lit("resume-after-failure")))
        .when(status == "failed", result(F.lit("needs-run"), F.lit("retry-failed")))
        .otherwise(result(status, reason))
    )


def first_difference(old: DataFrame, new: DataFrame, text: Column | None = None) -> DataFrame:
    """(stage, reason) from (stage, kind, name, value) of both sides: by priority, then name.

    ``text`` words it, over kind, name and the values ``_o`` and ``_n``.
    """
    rank = F.lit(len(PRIORITY))
    for i, kind in enumerate(PRIORITY):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    a = old.select("stage", "kind", "name", F.col("value").alias("_o"))
    b = new.select("stage", "kind", "name", F.col("value").alias("_n"))
    if text is None:
        text = F.concat(F.col("kind"), F.lit(": "), F.col("name"), F.lit(" "), F.coalesce("_o", F.lit("absent")), F.lit(" -> "), F.coalesce("_n", F.lit("absent")))
    differs = a.join(b, ["stage", "kind", "name"], "full_outer").where("not (_o <=> _n)")
    return differs.groupBy("stage").agg(F.min(F.struct(rank.alias("p"), "name", text.alias("t"))).alias("f")).select("stage", F.col("f.t").alias("reason"))


def review_outcome(relation: Column, recorded: Column, wanted: Column) -> Column:
    return F.when(relation != "changed", "not-needed").when(recorded.isNotNull() & (recorded == wanted), "already-decided").otherwise("recorded")


def provenance(key: Column, attempt_key: Column, attempt_source: Column, failure_key: Column, failure_source: Column, success_source: Column, reusable: Column) -> Column:
    """Baseline source: the attempt's, then the failure's, under the current key; else a reusable success's."""
    return F.coalesce(F.when(attempt_key == key, attempt_source), F.when(failure_key == key, failure_source), F.when(reusable, success_source))
