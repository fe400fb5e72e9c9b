"""Queries of scoring and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as op
from ..sources.adapters import CONFIG, EVENTS, FLAGS, SUBMISSIONS
from .registry import query

RANK = "(case severity when 'info' then 0 when 'low' then 1 when 'medium' then 2 else 3 end)"
NAME = "(case coalesce({0}, 0) when 0 then 'info' when 1 then 'low' when 2 then 'medium' else 'high' end)"
BASE = "(case severity when 'info' then 0 when 'low' then 1 when 'medium' then 3 else 8 end)"
SCORED = f"""with {SUBMISSIONS}, {FLAGS}, {CONFIG}, scored as (select f.*, {BASE} * confidence * coalesce(weight, 1) as flag_score, {RANK} as rk
  from flags f left join config c using (heuristic_id) where coalesce(enabled, true))"""
CHANGES = f"""with {SUBMISSIONS}, {FLAGS}, {CONFIG}, g as (select submission_id as id,
  sum(case when a.enabled then {BASE} * confidence * a.weight end) as o, max(case when a.enabled then {RANK} end) as orank,
  sum(case when b.enabled then {BASE} * confidence * b.weight end) as n, max(case when b.enabled then {RANK} end) as nrank
  from flags f join config a using (heuristic_id) join candidate b using (heuristic_id) group by 1),
changes as (select id, round(coalesce(o, 0), 6) as old_score, round(coalesce(n, 0), 6) as new_score, {NAME.format("orank")} as old_severity, {NAME.format("nrank")} as new_severity from subs left join g using (id))"""


def scored(t):
    return op.scored_flags(t.flags(), t.config())


def changes(t):
    return op.score_changes(t.submissions().select("id"), t.flags(), t.config(), t.config(True))


@query("h01_flag_scores", f"{SCORED} select submission_id, line, part, supp, heuristic_id, severity, round(flag_score, 6) as flag_score from scored")
def h01(t):
    return scored(t).select("submission_id", "line", "part", "supp", "heuristic_id", "severity", F.round("flag_score", 6).alias("flag_score"))


@query("h02_submission_scores", f"{SCORED}, g as (select submission_id as id, sum(flag_score) as s, max(rk) as m from scored group by 1) select id, round(coalesce(s, 0), 6) as score_total, {NAME.format('m')} as score_max_severity from subs left join g using (id)")
def h02(t):
    return op.submission_scores(t.submissions().select("id"), scored(t))


@query(
    "h03_supporting_events",
    f"with {EVENTS}, f as (select submission_id::varchar || '-' || kind as flag_id, global_idx, session_id from ev where kind in ('paste', 'git.event')) select flag_id, list(global_idx order by global_idx) as places, case when min(session_id) = max(session_id) then min(session_id) else '' end as session_id from f group by 1",
)
def h03(t):
    e = t.events()
    f = e.where(F.col("kind").isin("paste", "git.event")).groupBy(F.concat_ws("-", "submission_id", "kind").alias("flag_id"), "submission_id").agg(F.collect_list(F.concat_ws(":", "session_id", F.col("seq").cast("string"))).alias("keys"))
    return op.supporting(f, e)


COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as n_{s}" for s in op.SEVERITIES)


@query("h04_severity_counts", f"with {FLAGS} select submission_id, {COUNTS} from flags group by 1")
def h04(t):
    return op.severity_counts(t.flags(), "submission_id")


@query("h05_top_flags", f"{SCORED}, p as (select *, row_number() over (partition by submission_id order by rk desc, confidence desc, line, part, supp) as place from scored) select submission_id, place, severity, confidence from p where place <= 3")
def h05(t):
    return op.top_flags(scored(t)).select("submission_id", F.col("place").cast("long").alias("place"), "severity", "confidence")


@query(
    "h06_contributor_scores",
    f"""{SCORED}, c as (select distinct submission_id, 'c' || (supp % 3)::varchar as contributor_key from flags), n as (select *, count(*) over (partition by submission_id) as n from c),
    j as (select n.submission_id, n.contributor_key, flag_score, rk, (n = 1 or 'c' || (supp % 3)::varchar = contributor_key) as own from n left join scored s using (submission_id))
    select submission_id, contributor_key, round(coalesce(sum(flag_score) filter (own), 0), 6) as score_total, count(*) filter (own and flag_score is not null) as flags, {NAME.format("max(rk) filter (own)")} as max_severity from j group by 1, 2""",
)
def h06(t):
    key = F.concat(F.lit("c"), (F.col("supp") % 3).cast("string"))
    return op.contributor_scores(scored(t).withColumn("contributor_key", key), t.flags().select("submission_id", key.alias("contributor_key")).distinct())


KNOWN = "known as (select distinct 'h' || (l_partkey % 31)::varchar as heuristic_id from lineitem)"


def known(t):
    return t.raw("lineitem").select(F.concat(F.lit("h"), (F.col("l_partkey") % 31).cast("string")).alias("heuristic_id")).distinct()


@query("h07_normalised_config", f"with {CONFIG}, {KNOWN} select heuristic_id, coalesce(enabled, true) as enabled, coalesce(weight, 1) as weight from known left join config using (heuristic_id)")
def h07(t):
    return op.normalised_config(t.config(), known(t))


@query(
    "h07_config_lint",
    f"""with {KNOWN}, c as (select 'h' || (p_partkey % 40)::varchar as heuristic_id, case when p_partkey % 11 = 0 then null else p_size / 10.0 - 0.5 end as weight from part where p_partkey % 40 <> 39 or p_partkey < 40),
    d as (select heuristic_id, weight, count(*) over (partition by heuristic_id) as n from c)
    select distinct heuristic_id, case when k.heuristic_id is null then 'unknown_rule' when n > 1 then 'twice' when weight is null then 'no_weight' when weight < 0 then 'negative_weight' else 'weight_too_large' end as error
    from d left join known k using (heuristic_id) where k.heuristic_id is null or n > 1 or weight is null or weight < 0 or weight > 3.5""",
)
def h07_lint(t):
    p = t.raw("part").where("p_partkey % 40 <> 39 or p_partkey < 40")
    c = p.select(F.concat(F.lit("h"), (F.col("p_partkey") % 40).cast("string")).alias("heuristic_id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") / 10.0 - 0.5).alias("weight"))
    return op.config_errors(c, known(t))


@query("h08_config_versions", "with v as (select s_nationkey as semester_id, s_suppkey as version, s_acctbal as created from supplier) select *, row_number() over (partition by semester_id order by version desc) as place, row_number() over (partition by semester_id order by version desc) = 1 as active from v")
def h08(t):
    return op.version_history(t.raw("supplier").select(F.col("s_nationkey").alias("semester_id"), F.col("s_suppkey").alias("version"), F.col("s_acctbal").alias("created")))


@query("h09_dry_run", f"{CHANGES} select * from changes")
def h09(t):
    return changes(t)


@query("h09_movers", f"{CHANGES} select id, old_score, new_score, round(new_score - old_score, 6) as delta from changes order by abs(round(new_score - old_score, 6)) desc, id limit 20")
def h09_movers(t):
    return op.movers(changes(t))


@query("h10_histogram", f"{CHANGES}, m as (select greatest(1.0, max(new_score)) as most from changes), b as (select least(floor(new_score / (most / 10)), 9)::bigint as bucket, count(*) as n from changes, m group by 1) select bucket, coalesce(n, 0) as n from range(10) r(bucket) left join b using (bucket)")
def h10(t):
    return op.histogram(changes(t), "new_score")


@query("h11_fast_path", f"with {CONFIG}, n as (select heuristic_id, enabled or heuristic_id = (select 'h' || max(p_partkey % 28)::varchar from part) as enabled, weight from candidate), d as (select case when not a.enabled and b.enabled then 're' when a.enabled <> b.enabled or a.weight <> b.weight then 'mod' end as ch from config a join n b using (heuristic_id)) select count(*) filter (ch = 're') = 0 as eligible, count(ch) as changed from d")
def h11(t):
    most = t.raw("part").agg(F.concat(F.lit("h"), F.max(F.col("p_partkey") % 28).cast("string")).alias("m"))
    new = t.config(True).crossJoin(F.broadcast(most)).withColumn("enabled", F.col("enabled") | (F.col("heuristic_id") == F.col("m"))).drop("m")  # one row
    return op.fast_path(t.config(), new)


@query(
    "h12_config_diff",
    f"with {CONFIG}, used as (select distinct 'h' || (p_partkey % 28)::varchar as heuristic_id, p_partkey % 28 % 9 = 0 and p_partkey % 28 % 2 = 0 as re from part) select heuristic_id, case when not a.enabled and (b.enabled or re) then 'reenabled' else 'modified' end as change from config a join candidate b using (heuristic_id) join used using (heuristic_id) where a.enabled <> (b.enabled or re) or a.weight <> b.weight",
)
def h12(t):
    k = F.col("p_partkey") % 28
    used = t.raw("part").select(F.concat(F.lit("h"), k.cast("string")).alias("heuristic_id"), ((k % 9 == 0) & (k % 2 == 0)).alias("re")).distinct()
    new = t.config(True).join(used, "heuristic_id").withColumn("enabled", F.col("enabled") | F.col("re")).drop("re")
    return op.config_diff(t.config().join(used, "heuristic_id", "left_semi"), new)


@query(
    "h13_recompute_jobs",
    """with i as (select o_custkey as job, case o_orderstatus when 'F' then 'failed' when 'O' then 'ok' when 'P' then case when o_orderkey % 2 = 0 then 'ok' else 'queued' end end as status from orders),
    g as (select job, count(*) as n, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'failed') as n_failed from i group by 1)
    select *, case when n_ok + n_failed < n then 'running' when n_failed = 0 then 'succeeded' when n_ok = 0 then 'failed' else 'partial' end as state from g""",
)
def h13(t):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderkey") % 2 == 0, "ok").otherwise("queued")
    return op.job_state(t.raw("orders").select(F.col("o_custkey").alias("job"), status.alias("status")), "job", "ok", "failed")
