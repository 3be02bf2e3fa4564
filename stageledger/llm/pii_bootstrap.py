"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base matches of four kinds are seeds. Around each stand lexical patterns: its shape
(digits and letters generalised), one and two words before it, one word after it. The
same patterns are read off candidates, which are stretches of one to ``LONGEST`` words
outside base matches that could be of a kind but that its expression missed: two card
numbers side by side, a phone number that runs on into an address, a number without its
country's code. Patterns and instances form a bipartite graph, a row per edge:

* a pattern's confidence for a kind is the share of its distinct instances that are
  known to be of that kind, with ``SMOOTHING`` unknown ones added;
* an instance's score is the noisy-or of its best pattern of each type;
* instances of ``ACCEPT`` or more become known, and ``ROUNDS`` such rounds are made.

Copies of a document add no instance, so they lend no confidence. Known instances' own
occurrences are the spans that are added; those of one kind that overlap are one span.

Texts are read once: what could hold any match are runs of words with a digit or an
``@`` (and bare punctuation between them), cut out with a few characters on either side.
Everything after that shuffles runs only.

Expressions of the base are written so that they can't backtrack over long runs: a word
is entered at its start, or where the last match ended, only.

Defined cases: a null text is empty; every row of the table is one row of the result,
whatever its doc_id, null or repeated; an added span must pass its kind's own check
(a card's digits and Luhn sum, an address's parts, a phone's 7 to 15 digits); counts
are those of the base; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize, table

KINDS = ["email", "ip", "card", "phone"]
#: The base's expressions, possessive where nothing that follows could need less.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A word with a digit or @, entered at its start.
_WORD = f"[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Runs: such words, and bare phone punctuation between them, spaces in between.
RUN = f"(?<![^{SPACE}]){_WORD}(?:\\x20++(?:{_WORD}|[().-]++(?![^{SPACE}])))*+"

#: Words of a candidate, and its characters.
LONGEST, MAX_LENGTH = 5, 64
#: Characters on either side that words before and after are read from.
AROUND = 48
SMOOTHING, ACCEPT, ROUNDS = 2.0, 0.9, 3


def runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id) of every row, and (uid, pos, start, run, before, after) of its runs; both written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.when(text.rlike("[0-9@]"), F.arrays_zip(F.split(text, RUN).alias("gap"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("run")))
    cut = F.transform(pieces, lambda p: F.struct(F.length(p["gap"]).alias("n"), tail(p["gap"]).alias("tail"), head(p["gap"]).alias("head"), p["run"].alias("run")))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), cut.alias("pieces")), "runs-of-rows")
    flat = rows.select("uid", F.posexplode("pieces").alias("pos", "p")).select("uid", "pos", "p.*")
    order = Window.partitionBy("uid").orderBy("pos")
    width = F.col("n") + F.coalesce(F.length("run"), F.lit(0))
    start = F.sum(width).over(order) - F.coalesce(F.length("run"), F.lit(0))
    flat = flat.select("uid", "pos", start.alias("start"), "run", F.col("tail").alias("before"), F.lead("head").over(order).alias("after"))
    found = materialize(flat.where("run is not null"), "runs")
    ids = materialize(rows.select("uid", "doc_id"), "rows")
    discard(rows)
    return ids, found


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def address(text: Column) -> Column:
    """Four numbers of at most 255 each."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return text.rlike(rf"^{part}(?:\.{part}){{3}}$")


def passes(kind: str, text: Column) -> Column:
    """The base's check of a match."""
    n = F.length(digits(text))
    return {"email": F.lit(True), "ip": address(text), "card": n.between(14, 19) & F.call_function("luhn_check", digits(text)), "phone": n.between(10, 15)}[kind]


def could_be(kind: str, text: Column) -> Column:
    """Whether a candidate has the form and passes the check of a kind."""
    n = F.length(digits(text))
    return {
        "email": text.rlike(r"^[^@]+@[^@]+$"),
        "ip": address(text),
        "card": text.rlike(r"^[0-9](?:[\x20./-]?[0-9])*+$") & n.between(14, 19) & F.call_function("luhn_check", digits(text)),
        "phone": text.rlike(r"^[+(]?[0-9][\x20()./0-9-]*$") & n.between(7, 15),
    }[kind]


def tail(text: Column) -> Column:
    return F.substring(text, -AROUND, AROUND)


def head(text: Column) -> Column:
    return F.substring(text, 1, AROUND)


def base_spans(found: DataFrame) -> DataFrame:
    """(uid, kind, start, stop, text, before, after): base matches that pass.

    No row repeats its run: what stands around a match is read off the matches beside it.
    """
    each = F.array(*[
        F.struct(F.lit(i).alias("kind"), F.arrays_zip(F.split("run", e).alias("gap"), F.regexp_extract_all(F.col("run"), F.lit(e), F.lit(0)).alias("text")).alias("parts"))
        for i, e in enumerate(EXPRESSIONS.values())
    ])
    needed = reduce(lambda a, b: a | b, [(F.lit(i) == F.col("e.kind")) & (F.col("run").contains(NEEDS[k]) if NEEDS[k] else F.lit(True)) for i, k in enumerate(KINDS)])
    parts = found.select("*", F.explode(each).alias("e")).where(needed)
    parts = parts.select("uid", "pos", "start", "before", "after", "e.kind", F.posexplode("e.parts").alias("k", "p")).select("uid", "pos", "start", "before", "after", "kind", "k", "p.gap", "p.text")
    order = Window.partitionBy("uid", "pos", "kind").orderBy("k")
    size = F.coalesce(F.length("text"), F.lit(0))
    parts = parts.select(
        "uid",
        "kind",
        (F.col("start") + F.sum(F.length("gap") + size).over(order) - size).alias("start"),
        "text",
        tail(F.concat(F.coalesce(F.lag("text").over(order), "before", F.lit("")), "gap")).alias("before"),
        head(F.concat(F.lead("gap").over(order), F.coalesce(F.lead("text").over(order), "after", F.lit("")))).alias("after"),
    ).where("text is not null")
    valid = reduce(lambda a, b: a | b, [(F.col("kind") == i) & passes(k, F.col("text")) for i, k in enumerate(KINDS)])
    return parts.where(valid).select("uid", "kind", "start", (F.col("start") + F.length("text")).alias("stop"), "text", "before", "after")


def candidates(found: DataFrame, base: DataFrame) -> DataFrame:
    """(uid, kinds, start, stop, text, before, after): stretches outside base matches that could be of a kind."""
    order = Window.partitionBy("uid", "pos").orderBy("k")
    split = found.select("uid", "pos", "start", "before", "after", F.posexplode(F.split("run", " ")).alias("k", "w"))
    size = F.length("w") + 1
    short = F.when((F.length("w") <= MAX_LENGTH) & (F.col("w") != ""), F.col("w"))
    near = lambda i: F.lead("w", i).over(order)
    split = split.select(
        "uid",
        (F.col("start") + F.sum(size).over(order) - size).alias("at"),
        F.array(short, *[F.lead(short, i).over(order) for i in range(1, LONGEST)]).alias("ws"),
        tail(F.concat_ws(" ", F.when(F.col("k") < 2, F.col("before")), tail(F.lag("w", 2).over(order)), tail(F.lag("w", 1).over(order)))).alias("l"),
        F.array(*[head(F.coalesce(near(i), "after", F.lit(""))) for i in range(1, LONGEST + 1)]).alias("rs"),
    )
    stretches = []
    for n in range(LONGEST):
        words = [F.col("ws")[i] for i in range(n + 1)]
        between = [x for w in words[1:] for x in (F.lit(" "), w)]
        stretches.append(F.struct(F.concat(words[0], *between).alias("raw"), F.col("rs")[n].alias("r")))  # null if a word is
    raw = split.select("uid", "at", "l", F.explode(F.array(*stretches)).alias("s")).select("uid", "at", "l", "s.*").where(F.length("raw") <= MAX_LENGTH)
    raw = raw.select("*", F.regexp_replace("raw", "^[^0-9A-Za-z+(]+", "").alias("cut")).select("*", F.regexp_replace("cut", "[^0-9A-Za-z)]+$", "").alias("text"))
    kinds = F.array_compact(F.array(*[F.when(could_be(k, F.col("text")), i) for i, k in enumerate(KINDS)]))
    start = F.col("at") + F.length("raw") - F.length("cut")
    before = F.concat(F.col("l"), F.lit(" "), F.substring("raw", F.lit(1), F.length("raw") - F.length("cut")))
    after = F.concat(F.substring("cut", F.length("text") + 1, F.lit(MAX_LENGTH)), F.lit(" "), F.col("r"))
    raw = raw.select("uid", kinds.alias("kinds"), start.alias("start"), (start + F.length("text")).alias("stop"), "text", before.alias("before"), after.alias("after")).where(F.size("kinds") > 0)
    # Outside base matches: by running bounds over starts, whatever their number.
    none = F.lit(None)
    marks = base.select("uid", none.cast("array<int>").alias("kinds"), "start", "stop", *[none.cast("string").alias(c) for c in ("text", "before", "after")])
    # Both frames grow from one end, so a row costs the same wherever it stands.
    by = lambda order: Window.partitionBy("uid").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("kinds").isNull()
    both = raw.unionByName(marks).withColumns({
        "_to": F.max(F.when(mark, F.col("stop"))).over(by(F.col("start"))),
        "_from": F.min(F.when(mark, F.col("start"))).over(by(F.col("start").desc())),
    })
    clear = (F.coalesce(F.col("_to"), F.lit(-1)) <= F.col("start")) & (F.col("_from").isNull() | (F.col("_from") >= F.col("stop")))
    return both.where(~mark & clear).drop("_to", "_from")


def shape(text: Column) -> Column:
    """Digits as 9; runs of letters, and words of an address with them, as a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), r"\p{L}+", "a"), "a[a9._%-]*(?=@)|(?<=@)[a9-]*a[a9-]*", "a")


def _edge_words(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.filter(F.split(F.lower(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " "), lambda w: w != "")


def patterns(occurrences: DataFrame) -> DataFrame:
    """(instance, type, pattern, kinds): an edge for each pattern that an occurrence stands in, once."""
    rows = occurrences.select("kinds", "text", F.lower("text").alias("instance"), _edge_words(F.col("before")).alias("l"), F.get(_edge_words(F.col("after")), F.lit(0)).alias("r"))
    one, two = F.element_at(F.slice("l", -1, 1), 1), F.array_join(F.slice("l", -2, 2), " ")
    edges = F.array_compact(F.array(
        F.struct(F.lit("shape").alias("type"), shape(F.col("text")).alias("pattern")),
        F.when(F.size("l") > 0, F.struct(F.lit("before").alias("type"), one.alias("pattern"))),
        F.when(F.size("l") > 1, F.struct(F.lit("before two").alias("type"), two.alias("pattern"))),
        F.when(F.col("r").isNotNull(), F.struct(F.lit("after").alias("type"), F.col("r").alias("pattern"))),
    ))
    return rows.select("instance", "kinds", F.explode(edges).alias("e")).select("instance", "e.*", "kinds").dropDuplicates(["instance", "type", "pattern"])


def bootstrap(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(instance, kind): what is known after ``ROUNDS`` rounds, seeds among it.

    ``edges`` (instance, type, pattern, kinds) and ``seeds`` (instance, kind) are written
    tables; a pattern that many instances share is a skewed join key of one.
    """
    sizes = edges.groupBy("type", "pattern").agg(F.count("*").alias("n"))
    known = seeds
    for _ in range(ROUNDS):
        good = edges.join(known, "instance").groupBy("type", "pattern", "kind").agg(F.count("*").alias("k"))
        confidence = materialize(good.join(sizes, ["type", "pattern"]).select("type", "pattern", "kind", (F.col("k") / (F.col("n") + SMOOTHING)).alias("c")), "confidence")
        rated = edges.join(confidence, ["type", "pattern"]).where(F.array_contains("kinds", F.col("kind")))
        best = rated.groupBy("instance", "kind", "type").agg(F.max("c").alias("c"))
        scores = best.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("score"))
        top = scores.where(F.col("score") >= ACCEPT).groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        found = top.select("instance", (-F.col("b.k")).cast("int").alias("kind")).join(seeds.select("instance"), "instance", "left_anti")
        new = materialize(seeds.unionByName(found), "known")
        discard(confidence)
        if known is not seeds:
            discard(known)
        known = new
    return known


def joined(spans: DataFrame) -> DataFrame:
    """(uid, kind, start, stop): spans of one kind that overlap become one."""
    order = Window.partitionBy("uid", "kind").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("uid", "kind", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def extract(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, base, added): spans (start, kind, stop) of each row, in order; kinds by their place in ``KINDS``."""
    rows, found = runs(docs)
    base = materialize(base_spans(found), "base-spans")
    others = materialize(candidates(found, base), "candidates")
    discard(found)
    seen = base.withColumn("kinds", F.array("kind")).select(*others.columns).unionByName(others)
    edges = materialize(patterns(seen), "edges")
    # A text that is a match of two kinds is known by the first.
    seeds = materialize(base.groupBy(F.lower("text").alias("instance")).agg(F.min("kind").alias("kind")), "seeds")
    known = bootstrap(edges, seeds)
    hits = others.withColumn("instance", F.lower("text")).join(known, "instance").where(F.array_contains("kinds", F.col("kind")))
    added = joined(hits.select("uid", "kind", "start", "stop"))
    every = base.select("uid", F.struct("start", "kind", "stop").alias("s"), F.lit(True).alias("own")).unionByName(added.select("uid", F.struct("start", F.col("kind").cast("int").alias("kind"), "stop").alias("s"), F.lit(False).alias("own")))
    spans = every.groupBy("uid").agg(F.array_sort(F.collect_list(F.when(F.col("own"), F.col("s")))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("s")))).alias("added"))
    out = materialize(rows.join(spans, "uid", "left"), "personal-data")
    for x in (rows, base, others, edges, seeds, known):
        discard(x)
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("base", "added")})


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op12_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    counts = [counted("base", at).alias(f"n_{name}") for at, name in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
