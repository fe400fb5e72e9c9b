"""Queries of the event index and the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import event_index as op
from ..sources.adapters import EVENTS, Tables
from .registry import query

FILE = "case when kind in ('doc.open', 'doc.change', 'doc.save', 'doc.close', 'paste', 'selection.change', 'fs.external_change') then path end"
EV = f"with {EVENTS}"
CURSORS = "cursors as (select submission_id, max(global_idx) // 2 as cursor from ev group by 1)"


def cursors(t: Tables):
    return t.events().groupBy("submission_id").agg(F.floor(F.max("global_idx") / 2).cast("long").alias("cursor"))


def contributed(t: Tables):
    return t.events().withColumn("contributor", (F.col("k") % 3).cast("long"))


@query("b01_global_order", f"{EV} select submission_id, session_id, seq, global_idx from ev")
def b01(t):
    return t.events().select("submission_id", "session_id", "seq", "global_idx")


@query("b02_session_dedupe", f"{EV} select submission_id, session_id, min(sha256(session_id || '-' || (k % 3)::varchar)) as slog_sha256 from ev group by 1, 2")
def b02(t):
    claims = t.plain_events().select("submission_id", "session_id", F.sha2(F.concat("session_id", F.lit("-"), (F.col("k") % 3).cast("string")), 256).alias("slog_sha256"))
    return op.one_log_per_session(claims)


@query("b03_event_file", f"{EV} select submission_id, global_idx, {FILE} as file from ev")
def b03(t):
    return t.events().select("submission_id", "global_idx", op.event_file().alias("file"))


@query(
    "b04_path_aliases",
    f"""{EV}, seen as (select distinct submission_id, session_id, case when k % 7 = 0 then 'old/' || path else path end as path from ev),
    canon as (select distinct submission_id, path from seen where path not like '%/%')
    select s.submission_id, s.path as alias, min(c.path) as path from (select distinct submission_id, path from seen) s join canon c
      on s.submission_id = c.submission_id and ends_with(s.path, '/' || c.path)
    where not exists (select 1 from seen a join seen b on a.submission_id = b.submission_id and a.session_id = b.session_id
      where a.submission_id = s.submission_id and a.path = s.path and b.path = c.path) group by 1, 2""",
)
def b04(t):
    seen = t.plain_events().withColumn("path", F.when(F.col("k") % 7 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")))
    return op.path_aliases(seen, seen.where("not contains(path, '/')"))


@query("b05_event_page", f"{EV} select submission_id, global_idx, kind, t from ev where kind in ('paste', 'doc.change') and t between 1000 and 500000000 and (submission_id > 5 or (submission_id = 5 and global_idx > 3)) order by submission_id, global_idx limit 500")
def b05(t):
    return op.event_page(op.matching_events(t.events(), ["paste", "doc.change"], t=(1000, 500000000)), (5, 3), limit=500).select("submission_id", "global_idx", "kind", "t")


WANTED = f"{EV}, m as (select * from ev where path = 'f2.py' and seq between 1 and 40 and ms >= 1704500000000 and kind in ('paste', 'doc.change', 'doc.open'))"


def wanted(t):
    return op.matching_events(t.events(), ["paste", "doc.change", "doc.open"], seq=(1, 40), ms=(1704500000000, None), path="f2.py")


@query("b05_event_page_back", f"{WANTED} select submission_id, global_idx, kind, seq from m where submission_id < 12 or (submission_id = 12 and global_idx < 40) order by submission_id desc, global_idx desc limit 300")
def b05_back(t):
    return op.event_page(wanted(t), (12, 40), descending=True, limit=300).select("submission_id", "global_idx", "kind", "seq")


@query("b05_event_totals", f"{WANTED} select submission_id, count(*) as total from m group by 1")
def b05_totals(t):
    return op.event_totals(wanted(t))


@query("b06_point_lookup", f"{EV} select submission_id, session_id, seq, kind from ev where global_idx = 7")
def b06(t):
    return t.events().where("global_idx = 7").select("submission_id", "session_id", "seq", "kind")


@query("b07_timeline", f"{EV} select submission_id, global_idx, kind, path from ev where kind in ('paste', 'doc.open') and path in ('f1.py', 'f2.py') and t between 0 and 400000000")
def b07(t):
    return op.timeline(t.events(), {"paste", "doc.open"}, {"f1.py", "f2.py"}, set(), (0, 400000000)).select("submission_id", "global_idx", "kind", "path")


@query(
    "b08_seek",
    f"""{EV}, targets as (select submission_id, min(ms) + (max(ms) - min(ms)) * d // 2 - 1 as target from ev, (values (0), (1), (3)) v(d) group by submission_id, d),
    j as (select e.submission_id, target, max(case when ms <= target then global_idx end) as pos, min(ms) as first, max(ms) as last,
      max(case when ms <= target then ms end) as at_ms from ev e join targets using (submission_id) group by 1, 2)
    select submission_id, target, coalesce(pos, 0) as global_idx, case when pos is null then 'before_start' when target > last then 'after_end' else 'inside' end as outcome,
      abs(target - coalesce(at_ms, first)) as gap_ms from j""",
)
def b08(t):
    span = t.events().groupBy("submission_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    targets = span.select("submission_id", F.explode(F.array(*[F.col("a") + F.floor((F.col("b") - F.col("a")) * d / 2) - 1 for d in (0, 1, 3)])).alias("target"))
    return op.seek(t.events(), targets.distinct())


STEP = f"""{EV}, st as (select *, lag(session_id) over w as before, ms - lag(ms) over w as gap_ms,
    coalesce(case when lag(session_id) over w = session_id then greatest(0, t - lag(t) over w) when lag(ms) over w is not null then least(greatest(ms - lag(ms) over w, 1000), 5000) end, 0) as step
    from ev window w as (partition by submission_id order by global_idx))"""


@query("b09_collapsed_clock", f"{STEP} select submission_id, global_idx, (sum(step) over (partition by submission_id order by global_idx))::bigint as collapsed from st")
def b09(t):
    return op.clock(t.events()).select("submission_id", "global_idx", "collapsed")


SEAMS = f"{STEP}, seams as (select submission_id, global_idx, before as from_session, session_id as to_session, gap_ms, step as collapsed_ms from st where before <> session_id)"


@query("b10_seams", f"{SEAMS} select * from seams")
def b10(t):
    return op.seams(t.events())


@query("b11_flagged_seams", f"{SEAMS} select distinct s.submission_id, s.global_idx, s.to_session from seams s join ev e on e.submission_id = s.submission_id and e.session_id = s.to_session and e.global_idx >= s.global_idx where e.kind = 'paste' and e.k % 2 = 0")
def b11(t):
    e = t.events()
    return op.flagged_seams(op.seams(e), e.where("kind = 'paste' and k % 2 = 0"))


MARKS = f"""{EV}, m0 as (select *, {FILE} as file, lag(session_id) over (partition by submission_id order by global_idx) as before from ev),
m1 as (select *, last_value(file ignore nulls) over (partition by submission_id order by global_idx rows between unbounded preceding and 1 preceding) as file_before from m0),
marks as (select submission_id, global_idx, (kind = 'paste')::int as paste, (kind = 'fs.external_change')::int as external,
  coalesce((file <> file_before)::int, 0) as file_switch, coalesce((before <> session_id)::int, 0) as seam, (k % 13 = 0)::int as flagged from m1)"""
AFTER = "over (partition by submission_id order by global_idx rows between 1 following and unbounded following)"


@query("b12_next_marks", f"{MARKS} select submission_id, global_idx, " + ", ".join(f"min(case when {m} = 1 then global_idx end) {AFTER} as next_{m}" for m in op.MARKS) + " from marks")
def b12(t):
    return op.next_marks(t.events(), t.events().where("k % 13 = 0"))


@query("b13_remaining_marks", f"{MARKS} select submission_id, global_idx, " + ", ".join(f"coalesce(sum({m}) {AFTER}, 0)::bigint as left_{m}" for m in op.MARKS) + " from marks")
def b13(t):
    return op.remaining_marks(t.events(), t.events().where("k % 13 = 0"))


@query(
    "b14_file_recency",
    f"""{EV}, {CURSORS}, r as (select submission_id, session_id, dense_rank() over (partition by submission_id order by min(global_idx)) as nth from ev group by 1, 2),
    x as (select e.*, r.nth, c.cursor, {FILE} as file from ev e join r using (submission_id, session_id) join cursors c using (submission_id) where global_idx <= cursor),
    h as (select submission_id, cursor, arg_max(nth, global_idx) as now_nth, arg_max(ms, global_idx) as now_ms from x group by 1, 2),
    f as (select submission_id, cursor, file as path, arg_max(nth, global_idx) as nth, arg_max(ms, global_idx) as ms from x where file is not null group by 1, 2, 3)
    select submission_id, cursor, path, case when nth = now_nth then now_ms - ms end as age_ms, now_nth - nth as sessions_ago from f join h using (submission_id, cursor)""",
)
def b14(t):
    return op.file_recency(t.events(), cursors(t))


CHANGES = f"""{EV}, c0 as (select submission_id, k % 3 as contributor, global_idx, {FILE} as file from ev),
c1 as (select *, lag(file) over (partition by submission_id, contributor order by global_idx) as before from c0 where file is not null),
changes as (select submission_id, contributor, global_idx, file from c1 where before is null or before <> file), {CURSORS},
active as (select submission_id, cursor, contributor, arg_max(file, global_idx) as file from changes join cursors using (submission_id) where global_idx <= cursor group by 1, 2, 3)"""


@query("b15_active_file_changes", f"{CHANGES} select * from changes")
def b15(t):
    return op.active_file_changes(contributed(t))


@query("b16_active_file_at", f"{CHANGES} select * from active")
def b16(t):
    return op.active_file_at(op.active_file_changes(contributed(t)), cursors(t))


@query("b17_current_external_change", f"{EV}, l as (select submission_id, path, arg_max(kind, global_idx) as kind, max(global_idx) as global_idx from ev where kind in ('fs.external_change', 'doc.change', 'selection.change') group by 1, 2) select submission_id, path, global_idx from l where kind = 'fs.external_change'")
def b17(t):
    return op.current_external_change(t.events())


RUNS = f"""{EV}, r0 as (select submission_id, global_idx, ms, k % 3 as contributor, ms - lag(ms) over w as gap, lag(k % 3) over w as before from ev window w as (partition by submission_id order by global_idx)),
r1 as (select *, sum((before is null or before <> contributor or gap > 120000)::int) over (partition by submission_id order by global_idx) as run from r0),
runs as (select submission_id, run::bigint as run, min(contributor) as contributor, min(ms) as start_ms, max(ms) as stop_ms, count(*) as events, coalesce(arg_min(gap, global_idx), 0) as gap_before_ms, arg_min(ms, global_idx) as first_ms from r1 group by 1, 2)"""


@query("b18_activity_runs", f"{RUNS} select submission_id, run, contributor, start_ms, stop_ms, events, case when run = 1 then 0 else gap_before_ms end as gap_before_ms, false as idle from runs union all select submission_id, run, null, first_ms - gap_before_ms, first_ms, 0, 0, true from runs where run > 1 and gap_before_ms > 120000")
def b18(t):
    return op.activity_runs(contributed(t))


@query(
    "b19_overlaps",
    f"""{EV}, env as (select submission_id, session_id, k % 3 as contributor, min(ms) as start_ms, max(ms) as stop_ms from ev group by 1, 2, 3),
    ends as (select submission_id, start_ms as p_ms, 1 as d from env union all select submission_id, stop_ms, -1 from env),
    p as (select submission_id, p_ms, sum(d) as d from ends group by 1, 2),
    s as (select submission_id, p_ms as start_ms, lead(p_ms) over w as stop_ms, (sum(d) over w)::bigint as active from p window w as (partition by submission_id order by p_ms))
    select * from s where active >= 2 and stop_ms > start_ms""",
)
def b19(t):
    env = contributed(t).groupBy("submission_id", "session_id", "contributor").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("stop_ms"))
    return op.overlaps(env)


@query(
    "b20_focus_away",
    f"""{EV}, f as (select *, last_value(case when kind = 'focus.change' then size end ignore nulls) over (partition by submission_id order by global_idx rows between unbounded preceding and current row) as s from ev)
    select submission_id, global_idx, coalesce(s % 2 = 1, false) as away, case when s % 2 = 1 then 'r' || (s % 3)::varchar end as reason from f""",
)
def b20(t):
    e = t.events().withColumn("gained", F.col("size") % 2 == 0).withColumn("reason", F.concat(F.lit("r"), (F.col("size") % 3).cast("string")))
    return op.focus_away(e)


EXT = "case k % 4 when 0 then 'acme.copilot-chat' when 1 then 'core.builtin' when 2 then 'lint.py_tools' else 'zed.theme' || (k % 6)::varchar end"


@query(
    "b21_extension_inventory",
    f"""{EV}, x as (select submission_id, {EXT} as extension, arg_max('1.' || size::varchar, global_idx) as version from ev group by 1, 2),
    y as (select *, list_has_any(regexp_split_to_array(lower(extension), '[._-]'), ['ai', 'copilot']) as ai from x where extension <> 'core.builtin')
    select *, row_number() over (partition by submission_id order by ai desc, extension) as place from y""",
)
def b21(t):
    e = t.events().withColumn("extension", F.expr("case k % 4 when 0 then 'acme.copilot-chat' when 1 then 'core.builtin' when 2 then 'lint.py_tools' else concat('zed.theme', k % 6) end"))
    return op.extension_inventory(e.withColumn("version", F.concat(F.lit("1."), F.col("size").cast("string"))), ["core.builtin"], ["ai", "copilot"])


@query("b22_session_summary", f"{EV} select submission_id, session_id, arg_min(wall, seq) as first_wall, count(*) as events from ev group by 1, 2")
def b22(t):
    return op.session_summary(t.events())


@query(
    "b25_cursor_position",
    f"""{EV}, {CURSORS} select submission_id, cursor, path, arg_max(size, global_idx) as range from ev join cursors using (submission_id)
    where kind = 'doc.change' and global_idx <= cursor group by 1, 2, 3""",
)
def b25(t):
    e = t.events().where("kind = 'doc.change'").withColumn("kind", F.lit("selection.change")).withColumn("range", F.col("size"))
    return op.cursor_position(e, cursors(t))


@query(
    "b26_lanes",
    f"""{CHANGES}, g as (select submission_id, cursor, file, count(*) as contributors from active group by 1, 2, 3)
    select submission_id, cursor, file, contributors, case when contributors = 1 then 'single' else 'converged' end as state,
      row_number() over (partition by submission_id, cursor order by contributors desc, file nulls last) <= 2 as lane from g""",
)
def b26(t):
    return op.lanes(op.active_file_at(op.active_file_changes(contributed(t)), cursors(t)), 2)
