"""Quality rules: a learned decision list (DataFrame functions only).

Base statistics of each text are counted with array functions. The labelled rows'
statistics are cut into at most ``BINS`` intervals per feature, and counted into
one cell per combination of intervals; that contingency table (at most
``BINS ** len(FEATURES)`` rows, whatever the input) is all that the driver sees.
Sequential covering grows each rule there: conditions ``feature <= t`` or
``feature > t`` are added while the Laplace precision on the growing two thirds
rises, then dropped again, last first, while the precision on the pruning third
doesn't fall. The rules come out as one ordered ``CASE WHEN`` expression.

A text of more than ``LONG`` bytes is counted from pieces of ``LONG_PIECE`` characters
instead, with the same result: its words, lines and windows are rows, never arrays in one.

Defined cases: a null or empty text has zero statistics and fails the base rule;
labels that are null are not learned from, repeated labels count once each; with no
usable labels the list is empty and all that pass the base rule are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, free_name, materialize, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BINS = 6
MAX_RULES = 12
MAX_CONDITIONS = 3
#: Bytes beyond which a text is counted from pieces, and a piece's characters, about.
LONG, LONG_PIECE = 1 << 20, 1 << 17
#: A rule must reject this share of the labelled bad rows.
MIN_COVER_SHARE = 0.01
#: Of what a rule rejects, this share must be bad; and, few rows counting less, as Laplace estimates it.
MIN_PRECISION, MIN_LAPLACE = 0.9, 0.8

#: Features of the learned list, as SQL over the base statistics.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


def windows(w: Column) -> Column:
    """A hash of every 3-word window, in order."""
    grams = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(grams, 1, F.greatest(F.size(w) - 2, F.lit(0)))


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_upper, n_marks.

    One pass looks for long texts and writes their pieces; only if there are any do they
    meet the others' statistics.
    """
    long = F.octet_length("text") > LONG
    pieces = materialize(_pieces(docs.where(long)), "pieces")
    if pieces.isEmpty():
        discard(pieces)
        return _short_statistics(docs, *keep)
    stats = materialize(_long_statistics(pieces), "long-statistics")
    discard(pieces)
    short = _short_statistics(docs.where(~F.coalesce(long, F.lit(False))), *keep)
    key, counted = free_name("_k", docs), [c for c in short.columns if c not in (*keep, "doc_id")]
    rows = docs.where(long).select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias(key))
    return short.unionByName(rows.join(stats.withColumnRenamed("key", key), key).select(*keep, "doc_id", *counted))


def _pieces(docs: DataFrame) -> DataFrame:
    """(key, by, i, piece) of each different text: pieces that end with a word ('words') and with a line ('lines')."""
    cut = lambda by, end: F.struct(F.lit(by).alias("by"), F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{LONG_PIECE}}}[^{end}]*"), F.lit(0)).alias("pieces"))
    rows = docs.select(F.sha2("text", 256).alias("key"), "text")
    rows = rows.select("key", F.explode(F.array(cut("words", SPACE), cut("lines", r"\n"))).alias("c")).select("key", "c.by", F.posexplode("c.pieces").alias("i", "piece"))
    return rows.groupBy("key", "by", "i").agg(F.first("piece").alias("piece"))


def _long_statistics(pieces: DataFrame) -> DataFrame:
    """The statistics of each key of ``pieces``."""
    words = pieces.where("by = 'words'").select("key", "i", "piece", _words("piece").alias("w"))
    sums = words.select("key", F.size("w").alias("n"), *_counts("piece")).groupBy("key").agg(F.sum("n").alias("n_words"), *[F.sum(c).alias(c) for c in ("word_chars", "n_symbols", "n_marks", "n_upper")])
    # Where each piece's words begin, and the two words after them.
    order = Window.partitionBy("key").orderBy("i")
    heads = words.select("key", "i", F.size("w").alias("n"), F.slice("w", 1, 2).alias("head"))
    following = F.slice(F.flatten(F.collect_list("head").over(order.rowsBetween(1, Window.unboundedFollowing))), 1, 2)
    placed = heads.select("key", "i", (F.sum("n").over(order) - F.col("n")).alias("start"), following.alias("after"))
    grams = words.select("key", "i", "w").join(placed, ["key", "i"]).select("key", "start", F.concat("w", "after").alias("w")).select("key", "start", F.posexplode(windows(F.col("w"))).alias("p", "h"))
    grams = grams.select("key", "h", (F.col("start") + F.col("p")).alias("p"))
    repeated = grams.groupBy("key", "h").agg(F.count("*").alias("m")).where("m > 1").select("key", "h")
    covered = grams.join(repeated, ["key", "h"]).select("key", F.explode(F.array("p", F.col("p") + 1, F.col("p") + 2)).alias("p")).distinct()
    lines = pieces.where("by = 'lines'").select("key", F.explode(_lines("piece")).alias("line")).groupBy("key", F.sha2("line", 256).alias("line")).agg(F.count("*").alias("m"))
    found = sums.join(covered.groupBy("key").agg(F.count("*").alias("n_repeat_words")), "key", "left").join(lines.groupBy("key").agg(F.sum(F.col("m") - 1).alias("n_dup_lines")), "key", "left")
    return found.na.fill(0, ["n_repeat_words", "n_dup_lines"])


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def _lines(text: str) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)


def _counts(text: str) -> list[Column]:
    """What is counted character by character."""
    return [
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    ]


def _short_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Statistics from arrays of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    rows = rows.select(*keep, "doc_id", "_t", F.translate("_t", "\t\n\x0b\x0c\r", "     ").alias("_s"))
    rows = rows.select(*keep, "doc_id", "_t", F.length(F.replace("_s", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"), F.array_remove(F.split("_s", " "), "").alias("_w"))
    rows = rows.select(
        *keep,
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        _lines("_t").alias("_l"),
        windows(F.col("_w")).alias("_h"),
    )
    counted = [*keep, "doc_id", "n_words", "word_chars", "n_symbols", "n_marks", "n_upper"]
    # Where a window is repeated (most texts have none): windows sorted by hash, of which
    # neighbours with one hash are repeats; the places of these, in order; words that they cover.
    z = F.sort_array(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(1), F.size("_h")).alias("p")))
    rows = rows.select(*counted, (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.when(F.size(F.array_distinct("_h")) < F.size("_h"), z).alias("_z"))
    pairs = F.zip_with("_z", F.slice("_z", 2, F.size("_z")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    rows = rows.select(*counted, "n_dup_lines", F.when(F.col("_z").isNotNull(), places).alias("_p"))
    ahead = F.zip_with("_p", F.slice("_p", 2, F.size("_p")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.col("_p").isNotNull(), F.aggregate(ahead, F.lit(0), lambda total, x: total + x)).otherwise(F.lit(0))
    rows = rows.select(*counted, "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    # A generator stands between counting and what follows, so that no filter repeats the counting.
    found = free_name("_f", docs)
    one = F.array(F.struct(*[c for c in rows.columns if c not in keep]))
    return rows.select(*keep, F.explode(one).alias(found)).select(*keep, f"{found}.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def holds(self, cell: tuple[int, ...], names: list[str]) -> bool:
        return (cell[names.index(self.feature)] > self.bin) == self.above

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool
    precision: float
    covered: int

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Cut points of each feature: between the quantiles of good and of bad rows, over all labelled rows."""
    # Ends and middles of both classes; BINS - 1 cuts at most.
    wanted = [("quality = 1", [0.5, 0.98]), ("quality = 0", [0.25, 0.5])]
    aggs = [F.percentile_approx(F.when(F.expr(where), F.col(name)), points, 10_000).alias(f"{name}_{k}") for name in FEATURES for k, (where, points) in enumerate(wanted)]
    row = labelled.agg(*aggs).first()
    found: dict[str, list[float]] = {}
    for name in FEATURES:
        good, bad = row[f"{name}_0"] or [], row[f"{name}_1"] or []
        cuts = {*good, *bad}
        if good and bad:
            cuts.add((good[-1] + bad[0]) / 2)
        found[name] = sorted(cuts)[: BINS - 1]
    return found


def contingency(labelled: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[tuple[int, ...], int, int, int]]:
    """(cell, fold, bad, good): counts of labelled rows by intervals; fold 2 is for pruning."""
    bins = [sum((F.when(F.col(n) > F.lit(t), 1).otherwise(0) for t in cuts[n]), F.lit(0)).alias(f"b_{n}") for n in FEATURES]
    fold = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2, 2).otherwise(0)
    cells = labelled.select(*bins, fold.alias("fold"), "quality").groupBy(*[f"b_{n}" for n in FEATURES], "fold").agg(F.count(F.when(F.col("quality") == 0, 1)).alias("bad"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"))
    return [(tuple(x[: len(FEATURES)]), x.fold, x.bad, x.good) for x in cells.collect()]


def learn(cells: list[tuple[tuple[int, ...], int, int, int]], cuts: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over the contingency table: rules that reject, in order."""
    names = list(FEATURES)
    options = [Condition(n, above, t, i) for n in names for i, t in enumerate(cuts[n]) for above in (True, False)]

    def count(rule: list[Condition], left, folds) -> tuple[int, int]:
        bad = good = 0
        for cell, fold, b, g in left:
            if fold in folds and all(c.holds(cell, names) for c in rule):
                bad, good = bad + b, good + g
        return bad, good

    def laplace(bad: int, good: int) -> float:
        return (bad + 1) / (bad + good + 2)

    rules: list[Rule] = []
    left = list(cells)
    least = MIN_COVER_SHARE * sum(b for _, _, b, _ in cells)
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        best = (laplace(*count([], left, (0,))), 0)
        while len(rule) < MAX_CONDITIONS:
            tried = [((laplace(b, g), b), c) for c in options if c not in rule for b, g in [count([*rule, c], left, (0,))] if b and b >= least * 2 / 3]
            if not tried or max(t[0] for t in tried) <= best:
                break
            best, found = max(tried, key=lambda t: (t[0], t[1].feature, t[1].bin if t[1].above else -t[1].bin))
            rule.append(found)
        while len(rule) > 1 and laplace(*count(rule[:-1], left, (2,))) >= laplace(*count(rule, left, (2,))):
            rule.pop()
        bad, good = count(rule, left, (0, 2))
        if not rule or bad < least or bad / max(1, bad + good) < MIN_PRECISION or laplace(bad, good) < MIN_LAPLACE:
            break
        rules.append(Rule(tuple(rule), False, bad / (bad + good), bad + good))
        left = [x for x in left if not all(c.holds(x[0], names) for c in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one expression; what no rule covers is kept."""
    if not rules:
        return F.lit(True)
    return F.expr("case " + " ".join(f"when {r.sql()} then {str(r.keep).lower()}" for r in rules) + " else true end")


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({n: F.expr(e).cast("double") for n, e in FEATURES.items()})


def fit(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn the list from all labelled rows among ``stats``; one job joins, two aggregate."""
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    labelled = materialize(with_features(stats).select("doc_id", *FEATURES).join(marks, "doc_id"), "labelled-statistics")
    cuts = thresholds(labelled)
    rules = learn(contingency(labelled, cuts), cuts)
    discard(labelled)
    return rules


def classify(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(base_statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = fit(stats, table(spark, sf_dir, "labels"))
    return classify(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_upper", "n_marks")
