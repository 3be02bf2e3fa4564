"""Queries over the driver's tables: each operator of the engine, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, decide, graph, keys, rollup
from . import relations as R
from .relations import sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


DAY = ("user_id", "day")

# Matrices and selectors


def _cells(s: SparkSession, d: str) -> DataFrame:
    return graph.expand("score", R.axes(s, d))


@query("matrix_expand", sql("axes") + "select lang, source, cell, position from cells")
def _(s, d):
    return _cells(s, d).select("lang", "source", "cell", "position")


@query("cell_path", sql("axes") + "select cell, path from cells")
def _(s, d):
    return _cells(s, d).select("cell", "path")


@query("matrix_align", sql("axes") + ", prep as (select id as lang, 'prep@lang=' || id as need from lang) select c.cell, p.need, cast(0 as bigint) as position from cells c join prep p using (lang)")
def _(s, d):
    prep = graph.expand("prep", {"lang": R.axes(s, d)["lang"]})
    return graph.align(_cells(s, d), prep, ["lang", "source"], ["lang"])


@query("fan_in_ordered", sql("axes") + "select 'prep@lang=' || lang as cell, cell as need, row_number() over (partition by lang order by position) - 1 as position from cells")
def _(s, d):
    prep = graph.expand("prep", {"lang": R.axes(s, d)["lang"]})
    return graph.align(prep, _cells(s, d), ["lang"], ["lang", "source"])


@query("axis_domain", sql("axes") + "select id, row_number() over (order by ord) - 1 as ord from source where id in (select source from documents where doc_id % 4 = 1)")
def _(s, d):
    wanted = R.read(s, d, "documents").where("doc_id % 4 = 1").select(F.col("source").alias("id"))
    return graph.active(R.axes(s, d)["source"], wanted)


@query("selector_filter", sql("axes") + "select cell from cells where lang = 'en'")
def _(s, d):
    return graph.select_cells(_cells(s, d), {"lang": ["en"]}).select("cell")


@query("slice_filter", sql("axes") + "select cell from cells where lang in ('en', 'fr') and source in ('src1', 'src3') union select 'prep@lang=' || id from lang where id in ('en', 'fr')")
def _(s, d):
    seeds = graph.select_cells(_cells(s, d), {"lang": ["en", "fr"], "source": ["src1", "src3"]}).select(F.col("cell").alias("stage"))
    prep = graph.expand("prep", {"lang": R.axes(s, d)["lang"]})
    edges = graph.align(_cells(s, d), prep, ["lang", "source"], ["lang"]).select(F.col("cell").alias("stage"), "need")
    return graph.closure(edges, seeds).select(F.col("stage").alias("cell"))


@query("selector_union", sql("axes") + "select cell, position from cells where lang = 'en' or source = 'src2'")
def _(s, d):
    cells = _cells(s, d)
    wanted = graph.select_cells(cells, {"lang": ["en"]}).select("cell").unionByName(graph.select_cells(cells, {"source": ["src2"]}).select("cell"))
    return cells.join(wanted, "cell", "left_semi").select("cell", "position")


@query("selector_canonical", "select distinct 'score@lang=' || lang || ',source=' || source as selector from documents")
def _(s, d):
    return R.read(s, d, "documents").select(graph.cell_name("score", ["lang", "source"]).alias("selector")).distinct()


@query("name_validation", "select doc_id, source, regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9._-]*$') as valid, regexp_matches(split_part(text, ' ', 1), '^[A-Za-z0-9][A-Za-z0-9._-]*$') as first_valid from documents")
def _(s, d):
    return R.read(s, d, "documents").select("doc_id", "source", F.col("source").rlike(graph.SAFE_NAME).alias("valid"), F.split_part("text", F.lit(" "), F.lit(1)).rlike(graph.SAFE_NAME).alias("first_valid"))


@query(
    "selector_priority",
    "with m as (select distinct source || case when doc_id % 2 = 0 then '.__main__' else '' end as module from documents), w as (select distinct source as wanted from documents), b as (select wanted, module, row_number() over (partition by wanted order by case when module = wanted then 0 else 1 end, module) r from w join m on module = wanted or module = wanted || '.__main__') select wanted, module from b where r = 1",
)
def _(s, d):
    docs = R.read(s, d, "documents")
    rows = docs.select(F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".__main__").otherwise("")).alias("module")).distinct()
    return graph.pick_selector(rows, docs.select(F.col("source").alias("wanted")).distinct())


@query("discovery_filter", "select source as module, lang as branch, count(*) as stores from documents where lang = 'en' and source like 'src1%' group by all")
def _(s, d):
    rows = R.read(s, d, "documents").where((F.col("lang") == "en") & F.col("source").startswith("src1"))
    return rows.groupBy(F.col("source").alias("module"), F.col("lang").alias("branch")).agg(F.count("*").alias("stores"))


# Stage graphs


@query("closure_down", sql("edges") + ", reach(stage) as (select 'r1' union all select e.stage from reach r join edges e on e.need = r.stage) select distinct stage from reach")
def _(s, d):
    return graph.closure(R.edges(s, d), s.range(1).select(F.lit("r1").alias("stage")), up=False)


@query("closure_up", sql("edges") + ", reach(stage) as (select 's' || s_suppkey from supplier where s_suppkey % 7 = 0 union all select e.need from reach r join edges e on e.stage = r.stage) select distinct stage from reach")
def _(s, d):
    seeds = R.read(s, d, "supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stage"))
    return graph.closure(R.edges(s, d), seeds)


@query("topo_levels", sql("edges") + "select stage, cast(case left(stage, 1) when 'r' then 0 when 'n' then 1 else 2 end as bigint) as level from (select stage from edges union select need from edges)")
def _(s, d):
    return graph.levels(R.edges(s, d))


@query(
    "topo_levels_diamonds",
    sql("edges", "dag") + ", walk(stage, level) as (select need, 0 from dag where need not in (select stage from dag) union select d.stage, w.level + 1 from walk w join dag d on d.need = w.stage) select stage, cast(max(level) as bigint) as level from walk group by stage",
)
def _(s, d):
    return graph.levels(R.dag(s, d))


@query("closure_diamonds", sql("edges", "dag") + ", reach(stage) as (select 's' || s_suppkey from supplier where s_suppkey % 50 = 0 union select d.stage from reach r join dag d on d.need = r.stage) select stage from reach")
def _(s, d):
    seeds = R.read(s, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stage"))
    return graph.closure(R.dag(s, d), seeds, up=False)


@query("select_modes", sql("edges") + "select 'only' as mode, 'n3' as stage union all select 'upto', 'n3' union all select 'upto', need from edges where stage = 'n3' union all select 'downstream', 'n3' union all select 'downstream', stage from edges where need = 'n3'")
def _(s, d):
    seed, edges = s.range(1).select(F.lit("n3").alias("stage")), R.edges(s, d)
    mode = lambda name, rows: rows.select(F.lit(name).alias("mode"), "stage")
    return mode("only", seed).unionByName(mode("upto", graph.closure(edges, seed))).unionByName(mode("downstream", graph.closure(edges, seed, up=False)))


@query(
    "external_blockers",
    sql("edges") + ", sel as (select 's' || s_suppkey as stage from supplier where s_suppkey % 10 = 0), up1 as (select distinct need as stage from edges where stage in (select stage from sel)), ups as (select stage from up1 union select need from edges where stage in (select stage from up1)) select stage, case when stage in ('n1', 'n2', 'r0') then 'hit' else 'needs-run' end as status from ups where stage not in ('n1', 'n2', 'r0')",
)
def _(s, d):
    selected = R.read(s, d, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stage"))
    statuses = s.range(3).select(F.element_at(F.array(F.lit("n1"), F.lit("n2"), F.lit("r0")), F.col("id").cast("int") + 1).alias("stage"), F.lit("hit").alias("status"))
    return graph.external_blockers(R.edges(s, d), selected, statuses)


@query("unknown_needs", "select 's' || s_suppkey as stage, 'n' || s_nationkey as need from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey < 3)")
def _(s, d):
    known = R.read(s, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("stage"))
    suppliers = R.edges(s, d).where("stage like 's%'")
    return graph.unknown_needs(suppliers, known)


@query("missing_upstream", sql("edges") + ", gone as (select * from back where left(need, 1) = 's' and cast(substr(need, 2) as bigint) % 3 <> 0) select stage, first(need order by position) as missing from gone group by stage")
def _(s, d):
    edges = R.back_edges(s, d)
    have = edges.where("not (need like 's%' and cast(substr(need, 2) as bigint) % 3 <> 0)").select(F.col("need").alias("stage"))
    return graph.missing_upstream(edges, have)


@query("upstream_fallback", sql("man") + "select o.path, coalesce(n.content_hash, o.content_hash) as fingerprint, n.path is null as recorded from man_old o left join man_new n using (path)")
def _(s, d):
    old, new = R.snapshot(s, d, False, False), R.snapshot(s, d, True, False).select("path", F.col("content_hash").alias("current"))
    return old.join(new, "path", "left").select("path", F.coalesce("current", "content_hash").alias("fingerprint"), F.col("current").isNull().alias("recorded"))


@query("plan_edges", sql("edges") + "select stage, need from edges where need in ('n1', 'n2') and left(stage, 1) = 's'")
def _(s, d):
    edges = R.edges(s, d)
    selected = edges.where("stage like 's%'").select("stage").unionByName(s.range(2).select(F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("stage")))
    return graph.plan_edges(edges, selected)


@query("needs_topk", sql("edges") + "select stage, string_agg(need, ', ' order by position) filter (position < 2) || case when count(*) > 2 then ' +' || (count(*) - 2) || ' more' else '' end as needs from back group by stage")
def _(s, d):
    return graph.needs_summary(R.back_edges(s, d))


@query("stage_groups", sql("edges") + "select need as base, count(*) as n, min(stage) as first from edges group by need")
def _(s, d):
    return rollup.first_seen(R.edges(s, d).withColumnRenamed("need", "base"), "base", "stage")


# Keys and manifests


@query("content_hash", "select doc_id, 'sha256:' || sha256(text) as content_hash from documents")
def _(s, d):
    return R.read(s, d, "documents").select("doc_id", keys.sha256(F.col("text")).alias("content_hash"))


@query("input_manifest", sql("whole") + "select distinct name, path, kind, content_hash from (select name, path, kind, content_hash from whole_old union all select name, path, kind, content_hash from whole_old where path % 2 = 0)")
def _(s, d):
    old = R.snapshot(s, d, False)
    return keys.manifest(old.unionByName(old.where("path % 2 = 0")))


#: Members of a node in the queries' digest trees, so few that small groups have several levels.
_FAN = 16


@query("file_digest_view", sql("whole") + R.tree("whole_old", "name", "path", "path || '|' || kind || '|' || content_hash"))
def _(s, d):
    return keys.digest_view(R.snapshot(s, d, False), _FAN)


@query("artifact_tree_hash", sql("whole") + R.tree("whole_new", "name", "path", "path || ':' || content_hash"))
def _(s, d):
    return keys.ordered_hash(R.snapshot(s, d, True), ["name"], ["path"], F.concat_ws(":", F.col("path").cast("string"), "content_hash"), _FAN)


@query("materialization_hash", sql("items") + R.tree("items", "stage", "idx", "idx || '=' || content_hash"))
def _(s, d):
    return keys.ordered_hash(R.items(s, d), ["stage"], ["index"], F.concat_ws("=", F.col("index").cast("string"), "content_hash"), _FAN)


@query("component_diff", sql("man") + "select coalesce(o.name, n.name) as name, coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change from man_old o full join man_new n on o.name = n.name and o.path = n.path where o.path is null or n.path is null or o.content_hash is distinct from n.content_hash")
def _(s, d):
    return keys.component_diff(R.snapshot(s, d, False, False), R.snapshot(s, d, True, False), ["name", "path"], "content_hash")


@query("stat_shortcut", sql("man") + "select n.path, case when o.path is null then 'new' when o.stamp = n.stamp and o.size = n.size then 'cached' else 'rehash' end as action, case when o.stamp = n.stamp and o.size = n.size then o.content_hash end as reused from man_new n left join man_old o using (path)")
def _(s, d):
    return keys.stat_shortcut(R.snapshot(s, d, True, False), R.snapshot(s, d, False, False))


@query("policy_precedence", sql("man") + "select path, content_hash from man_new where path not in (select path from man_old)")
def _(s, d):
    return keys.without_rerun(R.snapshot(s, d, True, False), R.snapshot(s, d, False, False), "path").select("path", "content_hash")


def _config(s: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0)
    return R.read(s, d, "events").select("event_id", k.alias("k"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), k, F.lit("user"), F.col("user_id").cast("string")).alias("config"))


_K = "regexp_extract(props, '[0-9]+')"
_JSON = f"""'{{"k":"' || {_K} || '","type":"' || event_type || '","user":"' || user_id || '"}}'"""


@query("canonical_json", f"select event_id, {_JSON} as json from events")
def _(s, d):
    return _config(s, d).select("event_id", keys.canonical_json(F.col("config")).alias("json"))


@query("input_key", f"""select event_id, 'sha256:' || sha256('{{"config":' || {_JSON} || ',"inputs":{{}},"rerun_source_fingerprint":"' || md5(event_type) || '","upstreams":{{}},"values":{{}}}}') as input_key from events""")
def _(s, d):
    none = F.lit("{}")
    c = _config(s, d)
    return c.select("event_id", keys.input_key(keys.canonical_json(F.col("config")), none, none, none, F.md5(F.col("config")["type"])).alias("input_key"))


@query("dual_key", f"""select event_id, sha256('{{"k":"' || {_K} || '"}}') as projected_key, sha256({_JSON}) as full_key from events""")
def _(s, d):
    c = _config(s, d)
    access = F.array(F.lit("k"))
    return c.select("event_id", F.sha2(keys.canonical_json(keys.project(F.col("config"), access)), 256).alias("projected_key"), F.sha2(keys.canonical_json(F.col("config")), 256).alias("full_key"))


@query("config_projection", f"""select event_id, case when event_id % 4 = 0 then {_JSON} else '{{"k":"' || {_K} || '","type":"' || event_type || '"}}' end as json from events""")
def _(s, d):
    access = F.when(F.col("event_id") % 4 != 0, F.array(F.lit("type"), F.lit("k"), F.lit("gone")))
    return _config(s, d).select("event_id", keys.canonical_json(keys.project(F.col("config"), access)).alias("json"))


@query("config_access_merge", f"""select event_id, case when event_id % 5 = 0 then null when event_id % 3 = 0 and event_id % 7 = 0 then null when event_id % 3 = 0 then array_to_string(list_sort(list_distinct([event_type, 'a', 'b'])), ',') else array_to_string(list_sort([event_type, 'a']), ',') end as access from events""")
def _(s, d):
    e, i = R.read(s, d, "events"), F.col("event_id")
    recorded = F.when(i % 5 != 0, F.array("event_type", F.lit("a")))
    previous = F.when(i % 7 != 0, F.array(F.lit("b"), F.lit("a")))
    return e.select("event_id", F.array_join(keys.merge_access(recorded, previous, F.lit(True), i % 3 == 0), ",").alias("access"))


@query("config_merge", f"""select event_id, '{{"k":' || case when event_id % 2 = 0 then 'null' else '"' || {_K} || '"' end || ',"type":"x","user":"' || user_id || '"}}' as json from events""")
def _(s, d):
    override = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit(None).cast("string"), F.lit("type"), F.lit("x"))).otherwise(F.create_map(F.lit("type"), F.lit("x")))
    merged = keys.merge_config(F.col("config"), override)
    return _config(s, d).select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))), {"ignoreNullFields": "false"}).alias("json"))


@query("override_name", f"select event_id, 'main_override_' || left(sha256({_JSON}), 12) as branch from events")
def _(s, d):
    return _config(s, d).select("event_id", keys.override_name(keys.canonical_json(F.col("config"))).alias("branch"))


# Decisions

_DECIDE = """case when failed then 'failed' when attempted and partial then 'resume' when attempted then 'needs-run' when success and key_match and (missing or mismatch) then 'needs-run'
 when success and key_match then 'hit' when partial then 'resume' else 'needs-run' end"""
_WHY = """case when failed then 'stage-failed' when attempted and partial then 'resume' when attempted then 'interrupted' when success and key_match and missing then 'artifact-missing'
 when success and key_match and mismatch then 'artifact-changed' when success and key_match then 'hit' when partial then 'resume' when not success then 'no-cache' else reason end"""


def _decided(s: SparkSession, d: str) -> DataFrame:
    f = R.flags(s, d)
    return f.withColumn("d", decide.decide(*[F.col(c) for c in ("failed", "attempted", "partial", "success", "key_match", "missing", "mismatch", "reason")]))


@query("decide", sql("flags") + f"select doc_id, {_DECIDE} as status, {_WHY} as why from flags")
def _(s, d):
    return _decided(s, d).select("doc_id", "d.status", F.col("d.reason").alias("why"))


@query("execution_overlay", sql("flags") + f", x as (select doc_id, partial, {_DECIDE} as status, {_WHY} as why from flags) select doc_id, case when doc_id % 5 = 0 or doc_id % 7 = 0 then 'needs-run' when status = 'failed' and partial then 'resume' when status = 'failed' then 'needs-run' else status end as status, case when doc_id % 5 = 0 then 'forced' when doc_id % 7 = 0 then 'source-changed' when status = 'failed' and partial then 'resume-after-failure' when status = 'failed' then 'retry-failed' else why end as why from x")
def _(s, d):
    o = decide.overlay(F.col("d.status"), F.col("d.reason"), F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0, F.col("partial"))
    return _decided(s, d).withColumn("o", o).select("doc_id", "o.status", F.col("o.reason").alias("why"))


@query("invalidation_reason", sql("man") + ", sides as (select coalesce(o.name, n.name) as stage, case coalesce(o.path, n.path) % 5 when 0 then 'source' when 1 then 'config' when 2 then 'value' when 3 then 'input' else 'upstream' end as kind, coalesce(o.path, n.path) as name, o.stamp as o, n.stamp as n from man_old o full join man_new n on o.path = n.path), d as (select *, row_number() over (partition by stage order by list_position(['source', 'config', 'value', 'input', 'upstream'], kind), name::varchar) r from sides where o is distinct from n) select stage, kind || ': ' || name || ' ' || coalesce(o::varchar, 'absent') || ' -> ' || coalesce(n::varchar, 'absent') as reason from d where r = 1")
def _(s, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in decide.PRIORITY]), (F.col("path") % 5).cast("int") + 1)
    side = lambda new: R.snapshot(s, d, new, False).select(F.col("name").alias("stage"), kind.alias("kind"), F.col("path").cast("string").alias("name"), F.col("stamp").cast("string").alias("value"))
    return decide.first_difference(side(False), side(True))


@query("review_overlay", sql("lbl") + "select doc_id, case when relationship <> 'changed' or decision = 'reuse' then 'hit' when decision = 'invalidate' then 'needs-run' else 'needs-review' end as status, case when relationship <> 'changed' or decision = 'reuse' then 'hit' else 'source-changed' end as reason from lbl")
def _(s, d):
    args = (F.col("relationship"), F.col("decision"))
    return R.reviews(s, d).select("doc_id", decide.effective(F.lit("hit"), *args).alias("status"), decide.effective_reason(F.lit("hit"), *args).alias("reason"))


@query("partial_provenance", sql("lbl") + "select doc_id, coalesce(case when doc_id % 4 = n_chars % 4 then 'attempt' end, case when doc_id % 3 = n_chars % 3 then 'failure' end, case when decision = 'reuse' then 'success' end) as baseline from lbl")
def _(s, d):
    c = F.col
    base = decide.provenance(F.lit(0), (c("doc_id") - c("n_chars")) % 4, F.lit("attempt"), (c("doc_id") - c("n_chars")) % 3, F.lit("failure"), F.lit("success"), c("decision") == "reuse")
    return R.reviews(s, d).select("doc_id", base.alias("baseline"))


@query("review_plan", sql("lbl") + "select doc_id, case when relationship <> 'changed' then 'not-needed' when decision = 'reuse' then 'already-decided' else 'recorded' end as outcome from lbl")
def _(s, d):
    return R.reviews(s, d).select("doc_id", decide.review_outcome(F.col("relationship"), F.col("decision"), F.lit("reuse")).alias("outcome"))


@query("review_rollup", sql("lbl") + "select base, case when bool_or(relationship = 'changed' and decision is null) then 'none' when count(distinct decision) filter (relationship = 'changed') > 1 then 'error' when count(distinct decision) filter (relationship = 'changed') = 1 then max(decision) filter (relationship = 'changed') when bool_or(relationship = 'current') then 'current' else 'not-applicable' end as review from lbl group by base")
def _(s, d):
    return rollup.review(R.reviews(s, d), "base")


@query("review_consistency", sql("lbl") + "select base, count(distinct decision) as fingerprints from lbl group by base having count(distinct decision) > 1")
def _(s, d):
    return rollup.inconsistent(R.reviews(s, d), "base", "decision")


@query("review_totals", sql("lbl") + ", o as (select base % 10 as shard, case when relationship <> 'changed' then 'unchanged' when decision is null then 'failed' else 'recorded' end as outcome from lbl), t as (select shard, count(*) filter (outcome = 'recorded') as recorded, count(*) filter (outcome = 'unchanged') as unchanged, count(*) filter (outcome = 'failed') as failed from o group by shard) select *, recorded || case when recorded = 1 then ' review' else ' reviews' end as message from t")
def _(s, d):
    outcome = F.when(F.col("relationship") != "changed", "unchanged").when(F.col("decision").isNull(), "failed").otherwise("recorded")
    return rollup.review_totals(R.reviews(s, d).select((F.col("base") % 10).alias("shard"), outcome.alias("outcome")), "shard")


# Roll-ups


@query("status_severity", sql("runs") + "select user_id, day, coalesce((['hit', 'needs-run', 'resume', 'failed', 'error'])[max(sev) + 1], 'hit') as status from leveled group by user_id, day")
def _(s, d):
    return R.runs(s, d).groupBy(*DAY).agg(rollup.worst(F.col("status")).alias("status"))


@query("status_gate", sql("runs") + "select user_id, day, status from gated")
def _(s, d):
    return R.runs(s, d).groupBy(*DAY).agg(rollup.effective(F.col("status")).alias("status"))


@query("status_histogram", sql("runs") + "select day, status, count(*) as n, cast(list_position(['needs-review', 'hit', 'needs-run', 'resume', 'failed', 'error'], status) - 1 as int) as position from runs group by day, status")
def _(s, d):
    return rollup.histogram(R.runs(s, d), "day")


@query("status_having", sql("runs") + "select user_id, day, status from gated where status in ('failed', 'error')")
def _(s, d):
    return _QUERIES["status_gate"](s, d).where(F.col("status").isin("failed", "error"))


@query("completion", sql("runs") + "select user_id, day, bool_and(status = 'hit') as complete from runs group by user_id, day")
def _(s, d):
    return rollup.completion(R.runs(s, d), *DAY)


@query("bulk_exit", sql("runs") + "select user_id, day, cast(case when bool_and(status = 'hit') then 0 when bool_and(status in ('hit', 'needs-review')) then 2 else 1 end as int) as exit_code from runs group by user_id, day")
def _(s, d):
    return rollup.bulk_exit(R.runs(s, d), *DAY)


_SUM = "cast(sum(cast(duration as decimal(18,4))) as double)"


@query("duration_rollup", sql("runs") + f"select user_id, day, {_SUM} as recorded_seconds, case when count(*) = count(duration) then {_SUM} end as complete_seconds, count(duration) as recorded, count(*) as total from runs group by user_id, day")
def _(s, d):
    return rollup.durations(R.runs(s, d), *DAY)


@query("last_run", "select user_id, max(case when event_id % 9 <> 0 then ts end) as last_run from events group by user_id")
def _(s, d):
    at = F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("string")).otherwise("no time")
    return rollup.last_run(R.read(s, d, "events").select("user_id", at.alias("committed_at")), "user_id")


@query("reason_rollup", sql("runs") + ", r as (select user_id, day, status, min(reason) as first, count(distinct reason) as n from runs join gated using (user_id, day, status) group by all) select user_id, day, status, first || case when n > 1 then ' (+' || (n - 1) || ' more)' else '' end as reason from r")
def _(s, d):
    return rollup.reasons(R.runs(s, d), *DAY)


@query("reason_summary", sql("edges") + "select stage, need, 'upstream ''' || case left(need, 1) when 'n' then 'nation' when 'r' then 'region' end || ''' changed' as reason from edges")
def _(s, d):
    logical = s.range(2).select(F.element_at(F.array(F.lit("n"), F.lit("r")), F.col("id").cast("int") + 1).alias("k"), F.element_at(F.array(F.lit("nation"), F.lit("region")), F.col("id").cast("int") + 1).alias("logical"))
    e = R.edges(s, d).withColumn("k", F.substring("need", 1, 1)).join(F.broadcast(logical), "k")  # two rows
    return e.select("stage", "need", F.replace(F.concat(F.lit("upstream '"), "need", F.lit("' changed")), "need", F.col("logical")).alias("reason"))


@query("run_summary", sql("runs") + "select user_id, day, coalesce((['hit', 'needs-run', 'resume', 'failed', 'error'])[max(sev) + 1], 'hit') as status, count(*) as cells, count(*) filter (status in ('needs-run', 'resume')) as ran, printf('%.2fs', coalesce(cast(sum(cast(duration as decimal(18,4))) filter (status in ('needs-run', 'resume')) as double), 0.0)) as elapsed from leveled group by user_id, day")
def _(s, d):
    return rollup.run_summary(R.runs(s, d), *DAY)


@query("run_markers", sql("runs") + "select event_id, case status when 'hit' then 'skip' when 'needs-run' then 'run' when 'resume' then 'run (resume)' when 'needs-review' then 'blocked' else 'stop: ' || status end as marker from runs")
def _(s, d):
    st = F.col("status")
    text = F.when(st == "hit", "skip").when(st == "needs-run", "run").when(st == "resume", "run (resume)").when(st == "needs-review", "blocked").otherwise(F.concat(F.lit("stop: "), st))
    return R.runs(s, d).select("event_id", text.alias("marker"))


@query("fold_policy", sql("runs") + "select user_id, count(*) >= 8 and not coalesce(bool_or(duration >= 30.0), false) as folded, count(*) as cells from runs group by user_id")
def _(s, d):
    return rollup.fold_policy(R.runs(s, d), "user_id")


@query("group_completion", sql("runs") + "select event_id, user_id, row_number() over w as done, count(*) over (partition by user_id) as size, row_number() over w = count(*) over (partition by user_id) as closes from runs window w as (partition by user_id order by ts, event_id)")
def _(s, d):
    return rollup.group_completion(R.runs(s, d), "user_id", "ts", "event_id").select("event_id", "user_id", "done", "size", "closes")


@query("latest_record", sql("runs") + "select user_id, status, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from runs) where r = 1")
def _(s, d):
    return rollup.latest(R.runs(s, d).select("user_id", "ts", "event_id", "status"), ["user_id"], ["ts", "event_id"]).select("user_id", "status", "event_id")


@query("ordered_distinct", "select source, min(doc_id) as first from documents group by source")
def _(s, d):
    return graph.ordered_distinct(R.read(s, d, "documents"), "source", "doc_id")


@query("duplicate_check", "select text, count(*) as n from documents group by text having count(*) > 1")
def _(s, d):
    return graph.duplicates(R.read(s, d, "documents"), "text")


# Batches


@query("batch_positions", sql("items") + "select stage, idx as \"index\", path from items")
def _(s, d):
    return R.items(s, d).select("stage", "index", "path")


@query("resume_remaining", sql("items") + "select stage, idx as \"index\" from items where idx % 3 <> 0")
def _(s, d):
    items = R.items(s, d)
    return batch.remaining(items, items.where("index % 3 = 0"), ["stage", "index"]).select("stage", "index")


@query("partial_validation", sql("items") + "select stage, bool_and(intact) as valid from items group by stage")
def _(s, d):
    items = R.items(s, d)
    now = items.select("path", F.when(F.col("intact"), F.col("content_hash")).otherwise("other").alias("content_hash"))
    return batch.valid(items, now, ["stage"])


@query("batch_progress", sql("items") + ", t as (select stage, case when stage % 4 <> 0 then 8 when idx > 0 then idx end as total from items where idx % 3 = 0), p as (select stage, count(*) as done, case when count(distinct total) = 1 then min(total) end as total from t group by stage) select *, done || '/' || coalesce(total::varchar, '?') as progress from p")
def _(s, d):
    total = F.when(F.col("stage") % 4 != 0, F.lit(8).cast("long")).when(F.col("index") > 0, F.col("index"))
    return batch.progress(R.items(s, d).where("index % 3 = 0").select("stage", total.alias("total")), "stage")


@query("partial_adoption", sql("items") + "select stage, idx as \"index\", case when idx % 2 = 0 then 'current' else 'projected' end as origin from items")
def _(s, d):
    rows = R.items(s, d).select("stage", "index")
    return batch.adopt(rows.where("index % 2 = 0").withColumn("origin", F.lit("current")), rows.withColumn("origin", F.lit("projected")), ["stage", "index"])


_EXACT = """case when {c} is null then '-' else length({x}) || ':' || {x} end"""


def _double(c: str) -> str:
    e = f"(floor(log2(abs({c}))) + case when abs({c}) / pow(2, floor(log2(abs({c})))) < 1 then -1 when abs({c}) / pow(2, floor(log2(abs({c})))) >= 2 then 1 else 0 end)"
    return f"case when {c} = 0 then '0' else case when {c} < 0 then '-' else '+' end || cast({e} as bigint) || ':' || cast((abs({c}) / pow(2, {e}) - 1) * 4503599627370496 as bigint) end"


def _fingerprint_sql() -> str:
    texts = {c: f"{c}::varchar" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")} | {c: _double(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    texts |= {c: c for c in ("l_returnflag", "l_linestatus")} | {"l_shipdate": "epoch_us(l_shipdate)::varchar"}
    row = " || ".join(_EXACT.format(c=c, x=f"({x})") for c, x in texts.items())
    total = lambda seed: f"cast(sum(cast('0x' || substr(md5('{seed};' || row), 1, 15) as bigint)) as varchar)"
    return f"with rows as (select {row} as row from lineitem) select count(*) as n, {total(17)} as a, {total(42)} as b from rows"


@query("dataset_fingerprint", _fingerprint_sql())
def _(s, d):
    return keys.dataset_fingerprint(R.read(s, d, "lineitem"), keys.portable_hash)


@query("dataset_fingerprint_fast")
def _(s, d):
    """Beyond SQL: the hash is Spark's own; what the engine takes of each artifact as it is written."""
    return keys.dataset_fingerprint(R.read(s, d, "lineitem"))


@query("file_sums", _fingerprint_sql())
def _(s, d):
    """The fingerprint from its files' sums, as a later pass would add them up."""
    return keys.summed(keys.file_sums(R.read(s, d, "lineitem"), keys.portable_hash))
