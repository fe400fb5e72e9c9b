"""Queries of scans and sinks over text made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import logs as op
from ..sources.adapters import EVENTS, FLAGS, ROSTER, SUBMISSIONS
from ..sources.keyed import KeyedTable
from .registry import query
from .scoring_queries import SCORED, scored
from .staging import new_path

EV = f"with {EVENTS}"
ZERO = "0" * 64


def log_lines(t):
    """One line of a log for each event; some are broken."""
    e = t.events()
    fields = F.to_json(F.struct(F.struct("path", "size").alias("data"), F.sha2("kind", 256).alias("hash"), "kind", F.lit(ZERO).alias("prev_hash"), "seq", F.col("t").cast("double").alias("t"), "wall"))
    line = F.when(F.col("k") == 7, F.substring(fields, 1, 20)).when(F.col("k") == 8, F.replace(fields, F.lit(ZERO), F.lit("zz"))).when(F.col("k") == 9, F.replace(fields, F.lit('"kind"'), F.lit('"kinds"'))).otherwise(fields)
    return e.select(F.col("session_id").alias("file"), (F.col("seq") + 1).alias("line_no"), line.alias("line"), "seq")


@query("a01_log_scan", f"{EV} select session_id as file, seq + 1 as line_no, case when k in (7, 8, 9) then null else kind end as kind, case k when 7 then 'not_an_envelope' when 8 then 'bad_hash' when 9 then 'missing_field' end as error from ev")
def a01(t):
    p = op.parsed_lines(log_lines(t))
    return p.select("file", "line_no", F.when(F.col("error").isNull(), F.col("kind")).alias("kind"), "error")


@query("a02_torn_tail", f"{EV}, l as (select session_id, max(seq) + 1 as line_no, arg_max(k, seq) as k from ev group by 1) select session_id as file, line_no from l where k % 2 = 0")
def a02(t):
    g = log_lines(t).join(t.events().select(F.col("session_id").alias("file"), "seq", "k"), ["file", "seq"]).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"), F.max_by("k", "seq").alias("k"))
    text = F.concat(F.array_join(F.transform("x", lambda s: s["line"]), "\n"), F.when(F.col("k") % 2 == 1, "\n").otherwise(""))
    return op.whole_files(g.select("file", text.alias("text"))).where("unterminated").select("file", "line_no")


@query("a03_checkpoints", f"{EV} select session_id as file, session_id, seq, sha256(kind) as hash, 's' || k::varchar as sig from ev where k % 5 = 0")
def a03(t):
    c = t.events().where("k % 5 = 0").groupBy("session_id").agg(F.collect_list(F.struct("seq", F.sha2("kind", 256).alias("hash"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("sig"))).alias("checkpoints"))
    return op.checkpoints(c.select(F.col("session_id").alias("file"), F.to_json(F.struct("session_id", F.lit("pk").alias("pubkey"), "checkpoints")).alias("text")))


def manifests(t):
    e = t.events()
    s = e.groupBy("submission_id", "session_id").agg(F.sha2(F.max("wall"), 256).alias("slog_sha256")).groupBy("submission_id").agg(F.collect_list(F.struct("session_id", "slog_sha256")).alias("sessions"))
    f = e.groupBy("submission_id", "path").agg(F.sha2(F.max("size").cast("string"), 256).alias("sha256")).groupBy("submission_id").agg(F.collect_list(F.struct("path", "sha256")).alias("submission_files"))
    return s.join(f, "submission_id").select("submission_id", F.to_json(F.struct(F.lit("2.0").alias("format_version"), "sessions", "submission_files")).alias("text"))


@query("a04_manifest_sessions", f"{EV} select submission_id, session_id, sha256(max(wall)) as slog_sha256 from ev group by 1, 2")
def a04(t):
    return op.manifest_parts(manifests(t))[0].select("submission_id", "session_id", "slog_sha256")


@query("a04_manifest_files", f"{EV} select submission_id, path, sha256(max(size)::varchar) as sha256 from ev group by 1, 2")
def a04_files(t):
    return op.manifest_parts(manifests(t))[1].select("submission_id", "path", "sha256")


@query(
    "a05_session_assembly",
    f"{EV}, f as (select session_id, case when submission_id % 4 = 0 then arg_min(kind, seq) else 'session.start' end as first from ev group by session_id, submission_id) select session_id as file, session_id, case when first <> 'session.start' then 'no_session_start' when right(session_id, 1) = '3' then 'no_meta' when right(session_id, 1) = '2' then 'session_id_mismatch' end as error from f",
)
def a05(t):
    e = t.events()
    kind = F.when((F.col("submission_id") % 4 != 0) & (F.col("seq") == 0), "session.start").otherwise(F.col("kind"))
    events = e.select(F.col("session_id").alias("file"), "seq", kind.alias("kind"), F.col("session_id").alias("named"))
    metas = e.select(F.col("session_id").alias("file")).distinct().where("file not like '%3'").select("file", F.when(F.col("file").endswith("2"), "other").otherwise(F.col("file")).alias("session_id"))
    return op.assembled(events, metas)


@query(
    "a06_roster",
    f"with {ROSTER}, r as (select id, case when id % 31 = 0 then null else 'S' || (id - case when id % 10 = 5 then 1 else 0 end)::varchar end as sid, case when id % 37 = 0 then null else display_name end as display_name, email, 't' || semester_id::varchar as team from roster) select id, sid, display_name, email, team, case when sid is null then 'no_sid' when display_name is null then 'no_name' when row_number() over (partition by lower(sid) order by id) > 1 then 'duplicate_sid' end as error from r",
)
def a06(t):
    i = F.col("id")
    sid = F.concat(F.when(i % 10 == 5, " s").otherwise("S"), (i - F.when(i % 10 == 5, 1).otherwise(0)).cast("string"), F.lit(" "))
    raw = t.roster().select("id", F.when(i % 31 != 0, sid).alias("﻿SID"), F.when(i % 37 == 0, "  ").otherwise(F.col("display_name")).alias("Display_Name "), F.col("email").alias("EMAIL"), F.concat(F.lit("t"), F.col("semester_id").cast("string")).alias("Team"))
    r = op.roster_rows(raw, "id")
    return r.select("id", F.upper("sid").alias("sid"), "display_name", "email", F.col("extras")["team"].alias("team"), "error")


@query("a07_submitters", "select o_orderkey as submission_id, x as sid from (select o_orderkey, unnest([case when o_custkey % 5 = 0 then null else o_custkey::varchar end, case when o_custkey % 3 = 0 then (o_custkey + 1)::varchar end]) as x from orders) where x is not null")
def a07(t):
    c = F.col("o_custkey")
    one = F.struct(F.when(c % 5 != 0, F.concat(F.lit(" "), c.cast("string"))).alias("sid"), F.lit("n").alias("name"))
    two = F.struct(F.when(c % 3 == 0, (c + 1).cast("string")).alias("sid"), F.lit("n").alias("name"))
    return op.submitters(t.raw("orders").select(F.col("o_orderkey").alias("submission_id"), F.array(one, two).alias("submitters"))).select("submission_id", "sid")


LISTING = "files as (select page_id % 10 as submission_id, case page_id % 6 when 0 then 'a/.recording/s' || page_id::varchar when 1 then 'a/b/f' || page_id::varchar when 2 then 'c/d/g' || page_id::varchar when 3 then 'c/d/.recording/x' || page_id::varchar when 4 then 'node_modules/' || page_id::varchar else 'top' || page_id::varchar end as path from pages)"


def listing(t):
    p = F.col("page_id")
    n = p.cast("string")
    path = F.when(p % 6 == 0, F.concat(F.lit("a/.recording/s"), n)).when(p % 6 == 1, F.concat(F.lit("a/b/f"), n)).when(p % 6 == 2, F.concat(F.lit("c/d/g"), n)).when(p % 6 == 3, F.concat(F.lit("c/d/.recording/x"), n)).when(p % 6 == 4, F.concat(F.lit("node_modules/"), n)).otherwise(F.concat(F.lit("top"), n))
    return t.raw("pages").select((p % 10).alias("submission_id"), path.alias("path"))


@query("a08_recording_scopes", f"with {LISTING}, s as (select distinct submission_id, case when path like 'a/.r%' then 'a/' else 'c/d/' end as scope from files where path like '%.recording/%') select f.submission_id, f.path, max(s.scope) as scope from files f left join s on s.submission_id = f.submission_id and starts_with(f.path, s.scope) where f.path not like 'node_modules/%' group by 1, 2")
def a08(t):
    return op.recording_scopes(listing(t), ".recording/")


@query("a09_selected_entries", f"with {LISTING}, e as (select submission_id, path, case when starts_with(path, 'c/d/') then path[5:] else path end as name from files union all select submission_id, path[5:], path[5:] from files where path like 'c/d/g%5' union all select submission_id, path || '.slog', path || '.slog' from files where path like 'top%') select submission_id, name, max(case when path like 'c/d/%' then path else ' ' || path end) as path from e where (submission_id, name) in (select submission_id, path[5:] from files where path like 'c/d/g%') or name like '%.slog' group by 1, 2".replace("max(case when path like 'c/d/%' then path else ' ' || path end) as path", "ltrim(max(case when path like 'c/d/%' then path else ' ' || path end)) as path"))
def a09(t):
    f = listing(t)
    bare = f.where("path like 'c/d/g%5'").select("submission_id", F.expr("substring(path, 5)").alias("path"))
    logs = f.where("path like 'top%'").select("submission_id", F.concat("path", F.lit(".slog")).alias("path"))
    manifest = f.where("path like 'c/d/g%'").select("submission_id", F.expr("substring(path, 5)").alias("path"))
    return op.selected_entries(f.unionAll(bare).unionAll(logs), manifest, "c/d/")


@query("a11_export", f"with {SUBMISSIONS} select id, student_id, assignment_id, validation_status, price from subs order by price desc, id limit 10000")
def a11(t):
    return op.exported(t.submissions(), ["id", "student_id", "assignment_id", "validation_status", "price"], [F.desc("price"), "id"])


@query(
    "a12_findings",
    f"""{SCORED}, {EVENTS}, f as (select submission_id, severity || ' ' || heuristic_id as text, row_number() over (partition by submission_id order by rk desc, confidence desc, line, part, supp) as place from scored)
    select id as submission_id, '1 validation' as section, 1 as place, 'report: ' || validation_status as text from subs union all select submission_id, '2 flags', place, text from f
    union all select submission_id, '3 cross flags', part, severity from flags where part % 7 = 0
    union all select distinct ev.submission_id, '4 events', global_idx, kind from ev join scored s on s.submission_id = ev.submission_id and s.supp % 40 = ev.global_idx""",
)
def a12(t):
    from pyspark.sql.window import Window as W

    from ..operators.scoring import rank

    w = W.partitionBy("submission_id").orderBy(F.desc(rank("severity")), F.desc("confidence"), "line", "part", "supp")
    checks = t.submissions().select(F.col("id").alias("submission_id"), F.lit("report").alias("check_id"), F.col("validation_status").alias("status"), F.lit(1).alias("place"))
    cross = t.flags().where(F.col("part") % 7 == 0).select("submission_id", F.col("part").alias("flag_id"), "severity")
    return op.findings(checks, scored(t).withColumn("place", F.row_number().over(w)).withColumn("supporting", F.col("supp") % 40), cross, t.events())


@query("a13_replaced_flags", f"with {FLAGS} select submission_id, line, part, severity from flags where submission_id % 10 <> 0 union all select submission_id, line, part, 'info' from flags where submission_id % 10 = 0 and line = 1")
def a13(t):
    f = t.flags().select("submission_id", "line", "part", "severity")
    keyed = f.where("submission_id % 10 = 0 and line = 1").withColumn("severity", F.lit("info"))
    gone = f.where("submission_id % 10 = 0").select("submission_id").distinct()
    table = KeyedTable(t.spark, new_path(t.spark, "flags"), f.schema, ["submission_id"])
    table.replace(f)
    table.replace(keyed, gone)
    return table.read()


@query("a14_upserted_stats", f"{EV}, o as (select submission_id, path, sum(size)::bigint as chars, max(k) as digest from ev where k < 60 group by 1, 2), n as (select submission_id, path, sum(size)::bigint as chars, case when submission_id % 2 = 0 then max(k) end as digest from ev where k >= 50 group by 1, 2) select coalesce(o.submission_id, n.submission_id) as submission_id, coalesce(o.path, n.path) as path, coalesce(n.chars, o.chars) as chars, coalesce(n.digest, o.digest) as digest from o full join n on o.submission_id = n.submission_id and o.path = n.path")
def a14(t):
    e = t.events()
    g = lambda df: df.groupBy("submission_id", "path").agg(F.sum("size").alias("chars"), F.max("k").alias("digest"))
    old = g(e.where("k < 60"))
    table = KeyedTable(t.spark, new_path(t.spark, "stats"), old.schema, ["submission_id"])
    table.replace(old)
    table.upsert(g(e.where("k >= 50")).withColumn("digest", F.when(F.col("submission_id") % 2 == 0, F.col("digest"))), ["submission_id", "path"])
    return table.read()


