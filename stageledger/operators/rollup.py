"""Status roll-ups: severity, the review gate, histograms, durations, reasons.

Every function takes and returns DataFrames, groups with partial aggregation and
collects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities of execution statuses; ``needs-review`` only gates.
SEVERITY = {"hit": 0, "needs-run": 1, "resume": 2, "failed": 3, "error": 4}
#: Fixed order of a status histogram.
HISTOGRAM = ["needs-review", "hit", "needs-run", "resume", "failed", "error"]
FOLD_CELLS, SLOW_SECONDS = 8, 30.0


def severity(status: Column) -> Column:
    found = F.lit(None).cast("int")
    for name, level in SEVERITY.items():
        found = F.when(status == name, level).otherwise(found)
    return found


def by_severity(level: Column) -> Column:
    found = F.lit("hit")
    for name, n in SEVERITY.items():
        found = F.when(level == n, name).otherwise(found)
    return found


def worst(status: Column) -> Column:
    """Most severe execution status; a group without any is a hit."""
    return by_severity(F.max(severity(status)))


def effective(status: Column) -> Column:
    """The review gate goes before any severity."""
    return F.when(F.bool_or(status == "needs-review"), "needs-review").otherwise(worst(status))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    order = F.lit(None).cast("int")
    for i, name in enumerate(HISTOGRAM):
        order = F.when(F.col("status") == name, i).otherwise(order)
    return rows.groupBy(*by, "status").agg(F.count("*").alias("n")).select(*by, "status", "n", order.alias("position"))


def exact(duration: Column) -> Column:
    """Durations add up as decimals, so that no order of addition shows."""
    return duration.cast("decimal(18,4)")


def durations(rows: DataFrame, *by: str) -> DataFrame:
    """Lenient sum (what is recorded), strict sum (null if any is missing) and recorded-of-total."""
    total = F.sum(exact(F.col("duration"))).cast("double")
    return rows.groupBy(*by).agg(
        total.alias("recorded_seconds"),
        F.when(F.count("*") == F.count("duration"), total).alias("complete_seconds"),
        F.count("duration").alias("recorded"),
        F.count("*").alias("total"),
    )


def reasons(rows: DataFrame, *by: str) -> DataFrame:
    """Distinct reasons at the group's status: the first, and how many more."""
    status = rows.groupBy(*by).agg(effective(F.col("status")).alias("status"))
    at = rows.join(status, [*by, "status"]).groupBy(*by, "status").agg(F.min("reason").alias("first"), F.count_distinct("reason").alias("n"))
    return at.select(*by, "status", F.when(F.col("n") > 1, F.concat("first", F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise(F.col("first")).alias("reason"))


def completion(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(((F.count("*") > 0) & F.bool_and(F.col("status") == "hit")).alias("complete"))


def bulk_exit(rows: DataFrame, *by: str) -> DataFrame:
    """0: all complete; 2: only pending reviews are not; else 1."""
    open_ = F.col("status") != "hit"
    return rows.groupBy(*by).agg(F.when(F.count(F.when(open_, 1)) == 0, 0).when(F.count(F.when(open_ & (F.col("status") != "needs-review"), 1)) == 0, 2).otherwise(1).alias("exit_code"))


def run_summary(rows: DataFrame, *by: str) -> DataFrame:
    ran = F.col("status").isin("needs-run", "resume")
    seconds = F.sum(F.when(ran, exact(F.col("duration")))).cast("double")
    return rows.groupBy(*by).agg(worst(F.col("status")).alias("status"), F.count("*").alias("cells"), F.count(F.when(ran, 1)).alias("ran"), F.format_string("%.2fs", F.coalesce(seconds, F.lit(0.0))).alias("elapsed"))


def fold_policy(rows: DataFrame, *by: str, cells: int = FOLD_CELLS, slow: float = SLOW_SECONDS) -> DataFrame:
    return rows.groupBy(*by).agg(((F.count("*") >= cells) & ~F.coalesce(F.bool_or(F.col("duration") >= slow), F.lit(False))).alias("folded"), F.count("*").alias("cells"))


def group_completion(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Running count within a group against its size; the last row closes the group."""
    per = Window.partitionBy(by)
    running = per.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("done", F.count("*").over(running)).withColumn("size", F.count("*").over(per)).withColumn("closes", F.col("done") == F.col("size"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: the greatest row of each key, as one aggregate (no window)."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def last_run(rows: DataFrame, *by: str) -> DataFrame:
    """Greatest commit time; text that is no time counts as missing."""
    return rows.groupBy(*by).agg(F.max(F.try_to_timestamp("committed_at").cast("timestamp_ntz")).alias("last_run"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Groups by key in order of first appearance."""
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def review(rows: DataFrame, *by: str) -> DataFrame:
    """A group's review: changed/none if any is undecided, else its one decision; two are an error."""
    changed = F.col("relationship") == "changed"
    decided = F.count_distinct(F.when(changed, F.col("decision")))
    undecided = F.bool_or(changed & F.col("decision").isNull())
    return rows.groupBy(*by).agg(
        F.when(undecided, "none").when(decided > 1, "error").when(decided == 1, F.max(F.when(changed, F.col("decision")))).when(F.bool_or(F.col("relationship") == "current"), "current").otherwise("not-applicable").alias("review")
    )


def review_totals(rows: DataFrame, *by: str) -> DataFrame:
    count = lambda what: F.count(F.when(F.col("outcome") == what, 1))
    found = rows.groupBy(*by).agg(count("recorded").alias("recorded"), count("unchanged").alias("unchanged"), count("failed").alias("failed"))
    plural = F.concat(F.col("recorded").cast("string"), F.when(F.col("recorded") == 1, " review").otherwise(" reviews"))
    return found.withColumn("message", plural)


def inconsistent(rows: DataFrame, by: str, fingerprint: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count_distinct(fingerprint).alias("fingerprints")).where("fingerprints > 1")
