"""Corpus pipeline over ``documents``: score, rule, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``docs`` as they came, extra ones too.

Defined cases: a stage judges null and empty texts as its operator does (kept by the
classifier if its prior is 1 or more likely, rejected by the rules for want of
words); rows of one doc_id are one document, of which the third stage keeps one row;
rows without a doc_id count there as documents of their own, those without words once
for each equal text; an empty table stays
empty; extra columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageledger.llm import decontamination, jaccard_join, packing, quality_classifier, quality_rules
from stageledger.llm.common import discard, free_name, materialize, table

#: Near duplicates here: five words, a similarity of 0.8 or more.
SHINGLE, THRESHOLD = 5, (4, 5)
#: Labelled rows that the quality rules are learned from, at most.
RULE_SAMPLE = 20_000


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the untouched row."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def quality_vote(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote rejects go."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name("_quality", docs)
    scored = quality_classifier.score(docs, model, *docs.columns, name=name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the learned decision list go.

    The list is learned from labelled rows of the table ``documents``, those among them
    that an earlier stage took away too: what is left has next to no bad ones to learn
    from. At most ``RULE_SAMPLE`` labelled rows are counted for it, those with the least
    hashes of their id.
    """
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(RULE_SAMPLE)
    marked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left_semi")
    learned = quality_rules.fit(quality_rules.base_statistics(marked), labels)
    stats = quality_rules.base_statistics(_whole(docs), "_row")
    return quality_rules.classify(stats, learned).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents stays: that with the least doc_id,
    or one without a doc_id if no other is there."""
    grouped = jaccard_join.labelled(docs, SHINGLE, THRESHOLD)
    first = grouped.where("first").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    rows = _whole(docs).withColumn("t", jaccard_join.text_key())
    kept = rows.join(first, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(kept.where("doc_id is null").dropDuplicates(["text"])).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item within the error budget go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the fewest sequences."""
    return packing.pack_documents(docs).drop("uid")


STAGES = [
    ("quality classifier", quality_vote),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Encoding, components and edit distances are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        discard(docs)  # a table that this run wrote
        docs = done
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the pieces are written
    return packed
