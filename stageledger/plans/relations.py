"""State relations derived from the driver's tables, in Spark and in SQL.

A query never scans more columns than its relation names. ``SQL`` has the same
relations as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: a group is a user's day."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    failed = F.when(k % 10 == 0, "error").otherwise("failed")
    kind = F.col("event_type")
    status = F.when(kind == "view", "hit").when(kind == "click", "needs-run").when(kind == "signup", "needs-review").when(kind == "purchase", "resume").otherwise(failed)
    return read(spark, sf_dir, "events").select(
        "user_id",
        F.col("ts").cast("date").alias("day"),
        "ts",
        "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("duration"),
        status.alias("status"),
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("reason"),
    )


def snapshot(spark: SparkSession, sf_dir: str, new: bool, whole: bool = True) -> DataFrame:
    """Two manifests of documents: name, path, kind, size, stamp, version, content_hash.

    Not ``whole``, each lacks some documents that the other has: for comparisons of the two.
    """
    d = read(spark, sf_dir, "documents")
    touched = F.lit(new) & (F.col("doc_id") % 11 == 0)
    text = F.when(touched, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
    d = d if whole else d.where(F.col("doc_id") % (5 if new else 7) != 0)
    return d.select(
        F.col("source").alias("name"),
        F.col("doc_id").alias("path"),
        F.lit("file").alias("kind"),
        F.col("n_chars").alias("size"),
        (F.col("n_chars") + F.when(touched, 1).otherwise(0)).alias("stamp"),
        F.lit(1).alias("version"),
        F.sha2(text, 256).alias("content_hash"),
    )


def axes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    d = read(spark, sf_dir, "documents")
    return {"lang": graph.axis(d, "lang"), "source": graph.axis(d, "source")}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batch items; texts over 100 characters have valid artifacts."""
    c = read(spark, sf_dir, "conversations")
    place = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1).cast("long")
    return c.select(F.col("conv_id").alias("stage"), place.alias("index"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.md5("text").alias("content_hash"), (F.length("text") > 100).alias("intact"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, need, position): regions are needed by nations, nations by suppliers and customers."""
    one = lambda t, a, x, b, y: read(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("stage"), F.concat(F.lit(b), F.col(y).cast("string")).alias("need"))
    found = one("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(one("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(one("customer", "c", "c_custkey", "n", "c_nationkey"))
    return found.withColumn("position", F.lit(0).cast("long"))


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, need) with diamonds: orders need their customer and parts, parts their suppliers, both lead to a nation."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    parts = lines.select(key("o", "l_orderkey").alias("stage"), key("p", "l_partkey").alias("need"))
    suppliers = lines.select(key("p", "l_partkey").alias("stage"), key("s", "l_suppkey").alias("need"))
    customers = orders.select(key("o", "o_orderkey").alias("stage"), key("c", "o_custkey").alias("need"))
    return edges(spark, sf_dir).select("stage", "need").unionByName(parts).unionByName(suppliers).unionByName(customers)


def back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other way round: a nation needs its suppliers and customers, by name."""
    e = edges(spark, sf_dir).select(F.col("need").alias("stage"), F.col("stage").alias("need"))
    return e.withColumn("position", (F.row_number().over(Window.partitionBy("stage").orderBy("need")) - 1).cast("long"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: base, relationship, decision."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality")
    decision = F.when(F.col("quality") == 1, "reuse").when(F.col("quality") == 0, "invalidate")
    return d.join(lab, "doc_id", "left").select("doc_id", F.floor(F.col("doc_id") / 3).alias("base"), "n_chars", decision.alias("decision"), F.when(F.col("n_chars") % 2 == 1, "changed").otherwise("current").alias("relationship"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the decision's inputs, from the digits of doc_id."""
    bit = lambda n: (F.shiftright("doc_id", n) % 2 == 1)
    names = ["failed", "attempted", "partial", "success", "key_match", "missing", "mismatch"]
    return read(spark, sf_dir, "documents").select("doc_id", *[bit(i).alias(n) for i, n in enumerate(names)], F.concat(F.lit("config: f"), (F.col("doc_id") % 3).cast("string")).alias("reason"))


_SNAPSHOT = "select source as name, doc_id as path, 'file' as kind, n_chars as size, n_chars + {stamp} as stamp, sha256({text}) as content_hash from documents"
_OLD = _SNAPSHOT.format(stamp="0", text="text")
_NEW = _SNAPSHOT.format(stamp="case when doc_id % 11 = 0 then 1 else 0 end", text="case when doc_id % 11 = 0 then text || '#' else text end")

SQL = {
    "runs": """runs as (select user_id, cast(ts as date) as day, ts, event_id, case when event_id % 5 <> 0 then value end as duration,
      case event_type when 'view' then 'hit' when 'click' then 'needs-run' when 'signup' then 'needs-review' when 'purchase' then 'resume'
        else case when cast(regexp_extract(props, '[0-9]+') as int) % 10 = 0 then 'error' else 'failed' end end as status,
      event_type || '-' || (event_id % 3) as reason from events),
    leveled as (select *, case status when 'hit' then 0 when 'needs-run' then 1 when 'resume' then 2 when 'failed' then 3 when 'error' then 4 end as sev from runs),
    gated as (select user_id, day, case when bool_or(status = 'needs-review') then 'needs-review' else
      coalesce((['hit', 'needs-run', 'resume', 'failed', 'error'])[max(sev) + 1], 'hit') end as status from leveled group by all)""",
    "whole": f"whole_old as ({_OLD}), whole_new as ({_NEW})",
    "man": f"man_old as ({_OLD} where doc_id % 7 <> 0), man_new as ({_NEW} where doc_id % 5 <> 0)",
    "axes": """lang as (select lang as id, row_number() over (order by lang) - 1 as ord from (select distinct lang from documents where lang is not null)),
    source as (select source as id, row_number() over (order by source) - 1 as ord from (select distinct source from documents where source is not null)),
    cells as (select l.id as lang, s.id as source, 'score@lang=' || l.id || ',source=' || s.id as cell, 'matrix/score/lang=' || l.id || '/source=' || s.id as path,
      row_number() over (order by l.ord, s.ord) - 1 as position from lang l cross join source s)""",
    "items": """items as (select conv_id as stage, row_number() over (partition by conv_id order by turn, role) - 1 as idx, conv_id || '/' || turn as path, md5(text) as content_hash, length(text) > 100 as intact from conversations)""",
    "edges": """edges as (select 'n' || n_nationkey as stage, 'r' || n_regionkey as need from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier
      union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
    back as (select need as stage, stage as need, row_number() over (partition by need order by stage) - 1 as position from edges)""",
    "dag": """dag as (select stage, need from edges union select 'o' || l_orderkey, 'p' || l_partkey from lineitem union select 'p' || l_partkey, 's' || l_suppkey from lineitem
      union select 'o' || o_orderkey, 'c' || o_custkey from orders)""",
    "lbl": """lbl as (select d.doc_id, cast(floor(d.doc_id / 3) as bigint) as base, n_chars, case quality when 1 then 'reuse' when 0 then 'invalidate' end as decision,
      case when n_chars % 2 = 1 then 'changed' else 'current' end as relationship from documents d left join labels l on d.doc_id = l.doc_id)""",
    "flags": "flags as (select doc_id, " + ", ".join(f"(doc_id >> {i}) % 2 = 1 as {n}" for i, n in enumerate(["failed", "attempted", "partial", "success", "key_match", "missing", "mismatch"])) + ", 'config: f' || (doc_id % 3) as reason from documents)",
}


def tree(source: str, by: str, order: str, item: str) -> str:
    """A digest tree of fan 16 over ``source``, four levels: groups of at most 65536 members."""
    level = """, t{k} as (select {by}, place >> 4 as place, case when count(*) = 1 and {k} > 1 then min(h) else 'sha256:' || sha256(string_agg(h, chr(10) order by place)) end as h, sum(m) as m from t{j} group by {by}, place >> 4)"""
    leaves = f", t0 as (select {by}, row_number() over (partition by {by} order by {order}) - 1 as place, {item} as h, 1 as m from {source})"
    return leaves + "".join(level.format(k=k, j=k - 1, by=by) for k in range(1, 5)) + f" select {by}, h as fingerprint, cast(m as bigint) as members from t4"


def sql(*names: str) -> str:
    return "with recursive " + ", ".join(SQL[n] for n in names) + " "
