"""Queries of log validation over chained lines made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import checks as op
from ..sources.adapters import EVENTS
from .registry import query

# Each row's hash is that of the previous row's text, so that it can be made in parallel; some rows are corrupted.
LINES = f"""with {EVENTS}, l0 as (select *, kind || ':' || seq::varchar || ':' || event_id::varchar as canonical,
    lag(kind || ':' || seq::varchar || ':' || event_id::varchar) over (partition by submission_id, session_id order by seq) as prev from ev),
l1 as (select *, coalesce(sha256(prev), repeat('0', 64)) as prev_hash from l0),
lines as (select submission_id, session_id, seq as position, case when event_id % 211 = 0 then seq + 1 else seq end as seq, kind, canonical, prev_hash,
    case when event_id % 997 = 0 then repeat('f', 64) else sha256(prev_hash || canonical) end as hash,
    case when event_id % 301 = 0 then t - 100000000 else t end as t, case when event_id % 97 = 0 then '2023' || substr(wall, 5) else wall end as wall, k, size, path, event_id from l1)"""


def lines(t):
    w = W.partitionBy("submission_id", "session_id").orderBy("seq")
    e = t.events().withColumn("canonical", F.concat_ws(":", "kind", F.col("seq").cast("string"), F.col("event_id").cast("string")))
    e = e.withColumn("prev_hash", F.coalesce(F.sha2(F.lag("canonical").over(w), 256), F.lit(op.GENESIS)))
    hit = lambda n: F.col("event_id") % n == 0
    return e.select(
        "submission_id", "session_id", F.col("seq").alias("position"), F.when(hit(211), F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"), "kind", "canonical", "prev_hash",
        F.when(hit(997), "f" * 64).otherwise(F.sha2(F.concat("prev_hash", "canonical"), 256)).alias("hash"), F.when(hit(301), F.col("t") - 100000000).otherwise(F.col("t")).alias("t"),
        F.when(hit(97), F.concat(F.lit("2023"), F.substring("wall", 5, 99))).otherwise(F.col("wall")).alias("wall"), "k", "size", "path", "event_id", "global_idx",
    )


@query("d01_chain_integrity", f"{LINES} select submission_id, session_id, position from lines where sha256(prev_hash || canonical) <> hash")
def d01(t):
    return op.chain_failures(lines(t)).select("submission_id", "session_id", "position")


BREAKS = f"""{LINES}, b0 as (select *, coalesce(lag(hash) over w, repeat('0', 64)) as lh, lag(t) over w as lt, lag(wall) over w as lw from lines window w as (partition by submission_id, session_id order by position)),
b1 as (select *, case when seq <> position then 'seq_gap' when lh <> prev_hash then 'prev_link' when sha256(prev_hash || canonical) <> hash then 'hash' when t < lt then 't' when wall < lw then 'wall' end as reason from b0),
breaks as (select submission_id, session_id, min(position) as position, arg_min(reason, position) as reason from b1 where reason is not null group by 1, 2)"""


@query("d02_first_break", f"{BREAKS} select * from breaks")
def d02(t):
    return op.first_break(lines(t))


@query("d03_seq_gaps", f"{LINES}, o as (select *, coalesce(lag(seq <> position) over (partition by submission_id, session_id order by position), false) as before from lines) select submission_id, session_id, position, seq from o where seq <> position and not before")
def d03(t):
    return op.seq_gaps(lines(t))


@query("d04_monotonic_t", f"{LINES}, o as (select *, lag(t) over (partition by submission_id, session_id order by position) as before from lines) select submission_id, session_id, seq, t, before from o where t < before")
def d04(t):
    return op.t_regressions(lines(t))


@query(
    "d05_monotonic_wall",
    f"""{LINES}, o as (select *, lag(wall) over (partition by submission_id, session_id order by position) as before from lines)
    select submission_id, session_id, seq, wall, before from o where wall < before and not exists (select 1 from lines s where s.submission_id = o.submission_id and s.session_id = o.session_id and s.kind = 'clock.skew' and s.position between o.position - 1 and o.position)""",
)
def d05(t):
    return op.wall_regressions(lines(t))


STATE = "case when kind in ('doc.change', 'paste') then sha256(path || size::varchar) end"


@query(
    "d06_save_hashes",
    f"""{LINES}, s0 as (select submission_id, session_id, path, position as seq, case when kind = 'fs.external_change' then 'doc.save' else kind end as kind, {STATE} as state, size from lines),
    s as (select *, lag(size) over w as prev_size, last_value(state ignore nulls) over (partition by submission_id, session_id, path order by seq rows between unbounded preceding and 1 preceding) as now,
      list(state) over (partition by submission_id, session_id, path order by seq rows between 32 preceding and 1 preceding) as recent from s0 window w as (partition by submission_id, session_id, path order by seq)),
    v as (select *, sha256(path || (case when size % 3 = 0 then coalesce(prev_size, 0) else size % 100 end)::varchar) as saved from s where kind = 'doc.save')
    select submission_id, session_id, path, seq, case when now is null then 'indeterminate' when now = saved then 'match' when list_contains(recent, saved) then 'late' else 'mismatch' end as verdict from v""",
)
def d06(t):
    w = W.partitionBy("submission_id", "session_id", "path").orderBy("seq")
    s = lines(t).withColumn("seq", F.col("position")).withColumn("kind", F.when(F.col("kind") == "fs.external_change", "doc.save").otherwise(F.col("kind")))
    s = s.withColumn("state", F.when(F.col("kind").isin("doc.change", "paste"), F.sha2(F.concat("path", F.col("size").cast("string")), 256)))
    size = F.when(F.col("size") % 3 == 0, F.coalesce(F.lag("size").over(w), F.lit(0))).otherwise(F.col("size") % 100)
    return op.save_hashes(s.withColumn("saved", F.sha2(F.concat("path", size.cast("string")), 256)))


MANIFEST = f"""{BREAKS}, obs as (select submission_id, path, arg_max(sha256(path || size::varchar), event_id) as recorded, arg_max(size, event_id) as last_size from lines where kind in ('doc.change', 'paste', 'doc.open') group by 1, 2),
manifest as (select distinct submission_id, path, case when path = 'f3.py' then 'attachment' else 'reviewed' end as role, case when submission_id % 17 = 0 and path = 'f1.py' then 'missing' else 'present' end as status, submission_id % 11 = 5 as provisional from lines),
fork as (select submission_id, path, arg_max(size, event_id) as s1, arg_min(size, event_id) as s2 from lines where submission_id % 9 = 4 and kind in ('doc.change', 'paste', 'doc.open') group by 1, 2),
verdicts as (select m.submission_id, m.path, role, status, case when role = 'attachment' then 'attachment' when status = 'missing' then 'missing' when provisional then 'unknown_provisional' when exists (select 1 from breaks b where b.submission_id = m.submission_id and b.reason in ('hash', 'prev_link')) then 'unknown_chain' when recorded is null then 'unknown_no_record'
      when s1 is not null then case when m.submission_id % 3 = 0 or s1 = 1 or s2 = 1 then 'match_concurrent' else 'unknown_concurrent' end when m.submission_id % 3 = 0 or last_size = 1 then 'match' else 'mismatch' end as verdict from manifest m left join obs using (submission_id, path) left join fork using (submission_id, path))"""


@query(
    "d07_submitted_files",
    f"{MANIFEST} select submission_id, path, verdict from verdicts",
)
def d07(t):
    return op.submitted_verdicts(*submitted(t))


def submitted(t):
    """manifest, observed, broken and concurrent of the submitted files."""
    ls = lines(t)
    observed = ls.where("kind in ('doc.change', 'paste', 'doc.open')").select("submission_id", "path", F.sha2(F.concat("path", F.col("size").cast("string")), 256).alias("sha256"), F.col("event_id").alias("global_idx"), "size")
    last = observed.groupBy("submission_id", "path").agg(F.max_by("size", "global_idx").alias("last_size"))
    m = ls.select("submission_id", "path").distinct().join(last, ["submission_id", "path"], "left")
    size = F.when(F.col("submission_id") % 3 == 0, F.col("last_size")).otherwise(1)
    m = m.select(
        "submission_id", "path", F.when(F.col("path") == "f3.py", "attachment").otherwise("reviewed").alias("role"),
        F.when((F.col("submission_id") % 17 == 0) & (F.col("path") == "f1.py"), "missing").otherwise("present").alias("status"), F.sha2(F.concat("path", size.cast("string")), 256).alias("submitted_sha256"),
        (F.col("submission_id") % 11 == 5).alias("provisional"),
    )
    ends = F.array_distinct(F.array(F.max_by("sha256", "global_idx"), F.min_by("sha256", "global_idx"))).alias("states")
    return m, observed, op.first_break(ls).where("reason in ('hash', 'prev_link')"), observed.where("submission_id % 9 = 4").groupBy("submission_id", "path").agg(ends)


@query("i17_submitted_file_list", f"{MANIFEST} select * from verdicts")
def i17(t):
    parts = submitted(t)
    return parts[0].select("submission_id", "path", "role", "status").join(op.submitted_verdicts(*parts), ["submission_id", "path"])


@query(
    "d08_concurrent_states",
    f"""with {EVENTS}, last as (select distinct submission_id, path, session_id, submission_id % 2 * (length(session_id) + right(session_id, 1)::int) % 3 as contributor from ev),
    before as (select distinct a.submission_id, a.session_id as a, b.session_id as b from last a join last b using (submission_id) where right(a.session_id, 1)::int + 2 <= right(b.session_id, 1)::int),
    open_ as (select * from last l where not exists (select 1 from before x join last m on m.submission_id = x.submission_id and m.session_id = x.b and m.path = l.path where x.submission_id = l.submission_id and x.a = l.session_id))
    select submission_id, path, count(distinct contributor) as contributors, count(*) as states from open_ group by 1, 2 having count(distinct contributor) >= 2""",
)
def d08(t):
    n = F.substring("session_id", -1, 1).cast("int")
    last = t.events().select("submission_id", "path", "session_id", ((F.col("submission_id") % 2) * (F.length("session_id") + n) % 3).alias("contributor")).distinct()
    s = last.select("submission_id", F.col("session_id").alias("a"), F.substring("session_id", -1, 1).cast("int").alias("na")).distinct()
    before = s.join(s.select("submission_id", F.col("a").alias("b"), F.col("na").alias("nb")), "submission_id").where("na + 2 <= nb").select("submission_id", "a", "b")
    return op.concurrent_last_states(last, before)


@query("d09_session_binding", f"with {EVENTS}, s as (select distinct submission_id, session_id, case when submission_id % 13 = 0 then session_id else 'sig' end as sig from ev) select submission_id, case when count(distinct sig) = 1 and count(sig) = count(*) then 'pass' else 'fail' end as status from s group by 1")
def d09(t):
    s = t.events().select("submission_id", "session_id", F.when(F.col("submission_id") % 13 == 0, F.col("session_id")).otherwise("sig").alias("manifest_sig")).distinct()
    return op.session_binding(s)


LOGS = f"""with {EVENTS}, logs as (select submission_id, session_id, case when submission_id % 5 = 0 then string_agg(kind, chr(13) || chr(10) order by seq) else string_agg(kind, chr(10) order by seq) end as log from ev group by submission_id, session_id),
man as (select submission_id, session_id, case when submission_id % 7 = 0 then 'short' when submission_id % 11 = 0 then sha256(log || 'x') when submission_id % 19 = 0 then null else sha256(replace(log, chr(13) || chr(10), chr(10))) end as expected from logs)"""


@query(
    "d10_log_bytes",
    f"{LOGS} select submission_id, session_id, case when expected is null or not regexp_matches(expected, '^[0-9a-f]{{64}}$') then 'not_evaluated' when sha256(log) = expected then 'match' when sha256(replace(log, chr(13) || chr(10), chr(10))) = expected then 'match_normalised' else 'mismatch' end as verdict from logs join man using (submission_id, session_id)",
)
def d10(t):
    g = t.events().groupBy("submission_id", "session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]).alias("kinds"))
    log = F.when(F.col("submission_id") % 5 == 0, F.array_join("kinds", "\r\n")).otherwise(F.array_join("kinds", "\n"))
    logs = g.select("submission_id", "session_id", log.alias("log"))
    s = F.col("submission_id")
    expected = F.when(s % 7 == 0, "short").when(s % 11 == 0, F.sha2(F.concat("log", F.lit("x")), 256)).when(s % 19 != 0, F.sha2(F.replace("log", F.lit("\r\n"), F.lit("\n")), 256))
    return op.log_bytes(logs, logs.select("submission_id", "session_id", expected.alias("slog_sha256")))


@query("d12_unanimous_coverage", f"with {EVENTS}, v as (select submission_id, session_id, case when size % 40 = 0 then 'partial' else 'exact' end as verdict from ev) select submission_id, session_id, case when min(verdict) = max(verdict) then min(verdict) else 'indeterminate' end as verdict from v group by 1, 2")
def d12(t):
    return op.unanimous(t.events().select("submission_id", "session_id", F.when(F.col("size") % 40 == 0, "partial").otherwise("exact").alias("verdict")))


@query(
    "d13_checkpoints",
    f"""{LINES}, cp as (select submission_id, session_id, case when event_id % 23 = 0 then seq + 1000 else seq end as seq, case when event_id % 31 = 0 then 'bad' else hash end as hash, event_id % 37 <> 0 as sig_ok from lines where event_id % 5 = 0),
    last as (select submission_id, session_id, max(seq) as last_seq from lines group by 1, 2),
    j as (select c.*, l.hash as logged, last_seq from cp c left join lines l using (submission_id, session_id, seq) left join last using (submission_id, session_id)),
    v as (select *, case when not sig_ok then 'bad_signature' when logged is null then 'absent' when logged <> hash then 'mismatch' else 'agree' end as verdict from j)
    select submission_id, session_id, count(*) filter (verdict = 'agree') as n_agree, count(*) filter (verdict = 'absent') as n_absent, count(*) filter (verdict = 'mismatch') as n_mismatch, count(*) filter (verdict = 'bad_signature') as n_bad_signature,
      count(*) filter (verdict = 'absent') > 0 and count(*) filter (verdict = 'absent' and seq <= last_seq) = 0 as tail_only from v group by 1, 2""",
)
def d13(t):
    ls = lines(t)
    e = F.col("event_id")
    cp = ls.where(e % 5 == 0).select("submission_id", "session_id", F.when(e % 23 == 0, F.col("seq") + 1000).otherwise(F.col("seq")).alias("seq"), F.when(e % 31 == 0, "bad").otherwise(F.col("hash")).alias("hash"), (e % 37 != 0).alias("sig_ok"))
    return op.checkpoint_agreement(cp, ls)


@query(
    "d14_manifest_downgrade",
    "select o_orderkey as submission_id, '1.' || (o_orderkey % 3)::varchar as version, list_sort(list_concat(case when o_custkey % 5 = 0 then ['rolling'] else [] end, case when o_custkey % 7 = 0 then ['contributors'] else [] end)) as fields from orders where o_orderkey % 4 <> 0 and (o_custkey % 5 = 0 or o_custkey % 7 = 0)",
)
def d14(t):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    version = F.when(k % 4 == 0, "2.0").otherwise(F.concat(F.lit("1."), (k % 3).cast("string")))
    fields = F.to_json(F.struct(version.alias("format_version"), F.lit(1).alias("files"), F.when(c % 5 == 0, F.lit(True)).alias("rolling"), F.when(c % 7 == 0, F.lit("c")).alias("contributors")))
    return op.manifest_downgrades(t.raw("orders").select(k.alias("submission_id"), fields.alias("manifest")))


CHECKS = "checks as (select l_orderkey as submission_id, ['chain', 'seq', 'monotonic_t', 'monotonic_wall', 'save_hashes', 'submitted_code', 'session_binding', 'log_bytes', 'bundle_extra'][l_linenumber % 9 + 1] as check_id, case when l_partkey % 10 = 0 then 'fail' when l_partkey % 7 = 0 then 'skipped' else 'pass' end as status, l_partkey, l_suppkey from lineitem)"


def check_rows(t):
    ids = F.array(*map(F.lit, (*op.CHECKS, "bundle_extra")))
    p = F.col("l_partkey")
    status = F.when(p % 10 == 0, "fail").when(p % 7 == 0, "skipped").otherwise("pass")
    return t.raw("lineitem").select(F.col("l_orderkey").alias("submission_id"), F.get(ids, F.col("l_linenumber") % 9).alias("check_id"), status.alias("status"))


PLACE = "list_position(['chain', 'seq', 'monotonic_t', 'monotonic_wall', 'save_hashes', 'submitted_code', 'session_binding', 'log_bytes'], check_id)"
REPORT = f"with {CHECKS} select submission_id, case when bool_or(status = 'fail') then 'fail' when bool_or(status = 'skipped') then 'warn' else 'pass' end as overall, coalesce(string_agg(check_id, ', ' order by {PLACE}) filter (status = 'fail'), '') as detail from checks where check_id <> 'bundle_extra' group by 1"


@query("d15_report_rollup", f"select submission_id, overall from ({REPORT})")
def d15(t):
    return op.report(check_rows(t)).select("submission_id", "overall")


@query("d16_report_detail", f"select submission_id, detail from ({REPORT}) where overall = 'fail'")
def d16(t):
    return op.report(check_rows(t)).where("overall = 'fail'").select("submission_id", "detail")


@query("i16_stored_validation", f"with {CHECKS} select submission_id, check_id, status from checks")
def i16(t):
    return check_rows(t)


@query(
    "d17_integrity_flags",
    """with c as (select l_orderkey as submission_id, ['manifest_sig', 'session_binding', 'chain_integrity', 'monotonic_t', 'monotonic_wall', 'submitted_code_match', 'log_bytes_match', 'checkpoint_chain_valid', 'manifest_downgrade', 'seq_contiguity'][l_partkey % 10 + 1] as check_id, l_suppkey % 3 = 0 as failed, l_linenumber % 4 = 0 as weaker from lineitem)
    select submission_id, case check_id when 'manifest_sig' then 'manifest_sig_invalid' when 'session_binding' then 'session_binding_invalid' when 'chain_integrity' then 'chain_broken' when 'monotonic_t' then 'monotonic_t_regression' when 'monotonic_wall' then 'monotonic_wall_regression' else check_id end as heuristic_id,
      case when weaker then 'low' when check_id in ('monotonic_t', 'monotonic_wall') then 'medium' else 'high' end as severity, case when weaker then 0.4 else 1.0 end::double as confidence from c where failed and check_id <> 'seq_contiguity'""",
)
def d17(t):
    ids = F.array(*[F.lit(x) for x in ("manifest_sig", "session_binding", "chain_integrity", "monotonic_t", "monotonic_wall", "submitted_code_match", "log_bytes_match", "checkpoint_chain_valid", "manifest_downgrade", "seq_contiguity")])
    weaker = F.col("l_linenumber") % 4 == 0
    c = t.raw("lineitem").select(F.col("l_orderkey").alias("submission_id"), F.get(ids, F.col("l_partkey") % 10).alias("check_id"), F.when(F.col("l_suppkey") % 3 == 0, "fail").otherwise("pass").alias("status"), F.when(weaker, "low").alias("override_severity"), F.when(weaker, 0.4).alias("override_confidence"))
    return op.integrity_flags(c)


@query(
    "d18_seal_reconciliation",
    f"""with {EVENTS}, s as (select distinct submission_id, session_id from ev), seals as (select submission_id, case when submission_id % 6 = 0 then session_id || 'x' else session_id end as session_id from s where submission_id % 5 <> 0)
    select submission_id, session_id, case when s.session_id is null then 'seal_without_log' else 'log_without_seal' end as state from (select *, session_id as a from s) s full join (select *, session_id as b from seals) q using (submission_id, session_id)
    where a is null or (b is null and submission_id % 3 <> 0)""".replace("s.session_id is null", "a is null"),
)
def d18(t):
    s = t.events().select("submission_id", "session_id").distinct()
    k = F.col("submission_id")
    seals = s.where(k % 5 != 0).withColumn("session_id", F.when(k % 6 == 0, F.concat("session_id", F.lit("x"))).otherwise(F.col("session_id")))
    return op.seal_reconciliation(seals, s, s.where(k % 3 == 0))


@query(
    "d19_seal_union",
    f"""with {EVENTS}, q as (select submission_id, path, sha256(path || size::varchar) as sha256, case when k % 9 <> 0 then wall end as sealed_at, global_idx as ord from ev),
    r as (select *, row_number() over (partition by submission_id, path order by sealed_at desc nulls first, ord desc) as n from q) select submission_id, path, sha256, ord from r where n = 1""",
)
def d19(t):
    e = t.events()
    return op.seal_union(e.select("submission_id", "path", F.sha2(F.concat("path", F.col("size").cast("string")), 256).alias("sha256"), F.when(F.col("k") % 9 != 0, F.col("wall")).alias("sealed_at"), F.col("global_idx").alias("ord")))


@query(
    "d20_completeness",
    f"""{BREAKS}, last as (select submission_id, session_id, case when arg_max(kind, position) = 'session.heartbeat' then 'session.end' else arg_max(kind, position) end as kind from lines group by 1, 2)
    select l.submission_id, l.session_id, case when b.reason is not null then 'corrupt' when kind = 'session.end' then 'complete' else 'dangling' end as state from last l left join breaks b on b.submission_id = l.submission_id and b.session_id = l.session_id and b.reason = 'hash'""",
)
def d20(t):
    ls = lines(t)
    ended = ls.withColumn("seq", F.col("position")).withColumn("kind", F.when(F.col("kind") == "session.heartbeat", "session.end").otherwise(F.col("kind")))
    return op.completeness(ended, op.first_break(ls).where("reason = 'hash'"))
