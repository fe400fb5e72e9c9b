"""Queries of the rules that need no replay of contents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import rules as op
from ..sources.adapters import EVENTS, FLAGS, PASTES
from .registry import query

EV = f"with {EVENTS}"


def ev(t):
    return t.events().withColumn("place", F.col("global_idx"))


@query(
    "c15_paste_candidates",
    f"{EV}, c as (select submission_id, session_id, global_idx, 0 as ord, path, 'p' || size::varchar as text from ev where kind = 'paste' union all select submission_id, session_id, global_idx, o, path, 'd' || (size + o)::varchar from ev, (values (0), (1)) v(o) where kind = 'doc.change' and k % 2 = 0) select *, row_number() over (partition by submission_id order by global_idx, ord) - 1 as nth from c",
)
def c15(t):
    e = t.events().withColumn("content", F.concat(F.lit("p"), F.col("size").cast("string"))).withColumn("source", F.when(F.col("k") % 2 == 0, "paste"))
    return op.paste_candidates(e.withColumn("deltas", F.array(F.concat(F.lit("d"), F.col("size").cast("string")), F.concat(F.lit("d"), (F.col("size") + 1).cast("string")))))


NEAR = "exists (select 1 from ev a where a.submission_id = p.submission_id and a.session_id = p.session_id and a.kind = 'fs.external_change' and abs(a.t - p.t) <= 5000000)"


@query(
    "e01_large_paste",
    f"{EV} select submission_id, 'large_paste' as heuristic_id, case when global_idx % 13 = 0 then 'info' when size * 2 >= 500 or size % 40 >= 30 then 'high' else 'medium' end as severity, case when {NEAR} then 0.6 else 0.8 end::double as confidence, session_id, global_idx as place from ev p where kind = 'paste' and (size * 2 >= 200 or size % 40 >= 10)",
)
def e01(t):
    e = ev(t).withColumn("n_chars", F.col("size") * 2).withColumn("n_lines", F.col("size") % 40)
    moves = e.where("global_idx % 13 = 0").select("submission_id", "place")
    return op.large_pastes(e.where("kind = 'paste'"), e.where("kind = 'fs.external_change'"), moves, near_ms=5000000)


@query(
    "e02_external_edits",
    f"""{EV}, c as (select *, case when t - lag(t) over w > 600000000 then 1 when lag(t) over w is null then 1 else 0 end as new from ev where kind = 'fs.external_change' and (k % 7 not in (1, 2) or k % 7 = 2 and k % 3 = 0) window w as (partition by submission_id, session_id, path order by t, global_idx)),
    r as (select *, sum(new) over (partition by submission_id, session_id, path order by t, global_idx) as run from c)
    select submission_id, 'external_edits' as heuristic_id, case when max(size) > 100 then 'high' else 'medium' end as severity, 0.9::double as confidence, session_id, path, min(global_idx) as place, count(*) as edits, count(*) filter (k % 7 = 2) as overridden from r group by submission_id, session_id, path, run""",
)
def e02(t):
    k = F.col("k")
    tagged = ev(t).where("kind = 'fs.external_change'").withColumn("explanation", F.when(k % 7 == 1, "formatter").when(k % 7 == 2, "git")).withColumn("overridden", (k % 7 == 2) & (k % 3 == 0))
    return op.external_edits(tagged.withColumn("diff_size", -F.col("size")), gap_ms=600000000)


@query(
    "e03_between_sessions",
    f"""{EV}, r as (select submission_id, session_id, min(ms) as start_ms, max(ms) as stop_ms, case when submission_id % 4 = 0 then null else submission_id % 3 end as contributor from ev group by 1, 2),
    p as (select *, lead(session_id) over w as next, lead(start_ms) over w as ns from r window w as (partition by submission_id order by start_ms, session_id)),
    x as (select submission_id, session_id, path, arg_max(size % 5, global_idx) as a, arg_min(size % 5, global_idx) as b, arg_max(size * 3, global_idx) as la, arg_min(size * 3, global_idx) as lb from ev group by 1, 2, 3)
    select p.submission_id, 'inter_session_external_change' as heuristic_id, case when abs(y.lb - x.la) > 100 then 'high' else 'medium' end as severity, 0.85::double as confidence, p.session_id, p.next, x.path from p join x using (submission_id, session_id) join x y on y.submission_id = p.submission_id and y.session_id = p.next and y.path = x.path where ns > stop_ms and x.a <> y.b""",
)
def e03(t):
    e = ev(t)
    r = e.groupBy("submission_id", "session_id").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("stop_ms")).withColumn("contributor", F.when(F.col("submission_id") % 4 != 0, F.col("submission_id") % 3))
    sha = F.col("size") % 5
    ends = e.groupBy("submission_id", "session_id", "path").agg(F.max_by(sha, "global_idx").alias("sha"), F.max_by(F.col("size") * 3, "global_idx").alias("length"))
    starts = e.groupBy("submission_id", "session_id", "path").agg(F.min_by(sha, "global_idx").alias("sha"), F.min_by(F.col("size") * 3, "global_idx").alias("length"))
    return op.between_sessions(r, ends, starts)


@query(
    "e04_low_typing",
    f"""{EV}, f as (select submission_id, path, sum(case when kind = 'doc.change' and size < 60 then size else 0 end)::bigint as typed, min(size) as start_len, sum(size)::bigint as final_len, sum(case when kind = 'git.event' then size else 0 end)::bigint as merged, max(k) > 97 as tainted from ev group by 1, 2),
    d as (select *, final_len - start_len - merged as delta, case when typed > 0 then (final_len - start_len - merged) / typed end as ratio from f where not tainted)
    select submission_id, 'low_typing_high_output' as heuristic_id, case when ratio is null or ratio >= 5 then 'high' else 'medium' end as severity, round(least(1.0, case when typed = 0 then delta / 500 else typed / 500 end), 6) as confidence, path from d where delta > 0 and (ratio is null or ratio >= 3)""",
)
def e04(t):
    size = F.col("size")
    f = ev(t).groupBy("submission_id", "path").agg(
        F.sum(F.when((F.col("kind") == "doc.change") & (size < 60), size).otherwise(0)).alias("typed"), F.min("size").alias("start_len"), F.sum("size").alias("final_len"),
        F.sum(F.when(F.col("kind") == "git.event", size).otherwise(0)).alias("merged"), (F.max("k") > 97).alias("tainted"),
    )
    return op.low_typing(f)


SAVED = "case when kind = 'fs.external_change' then 'doc.save' else kind end"


@query(
    "e07_first_save",
    f"""{EV}, s as (select *, {SAVED} as kd from ev), o as (select * from s where kd = 'doc.open'),
    n as (select o.submission_id, o.session_id, o.path, o.global_idx, o.t, min(s.global_idx) as g from o join s on s.submission_id = o.submission_id and s.session_id = o.session_id and s.path = o.path and s.kd = 'doc.save' and (s.t > o.t or (s.t = o.t and s.global_idx > o.global_idx)) group by all)
    select n.submission_id, 'time_to_first_save_anomaly' as heuristic_id, 'high' as severity, 0.8::double as confidence, n.session_id, n.path, n.global_idx as place from n join ev s on s.submission_id = n.submission_id and s.global_idx = n.g where s.t - n.t < 86400000 and s.size > 60""",
)
def e07(t):
    e = ev(t).withColumn("kind", F.expr(SAVED)).withColumn("new_chars", F.col("size"))
    return op.first_save_anomaly(e, 86400000, 60)


@query(
    "e08_idle_then_complete",
    f"""{EV}, s as (select *, {SAVED} as kd from ev), fin as (select submission_id, path, max(size) as final_len from ev group by 1, 2),
    b as (select submission_id, session_id, lag(t) over (partition by submission_id, session_id order by t, global_idx) as t0, t as t1 from ev where kind = 'session.heartbeat'),
    h as (select b.submission_id, b.session_id, s.path, s.global_idx as place, final_len, t0 from b join s using (submission_id, session_id) join fin f on f.submission_id = s.submission_id and f.path = s.path where t1 - t0 > 600000 and kd = 'doc.save' and s.size >= final_len - 100 and s.t between t1 and t1 + 60000000),
    j as (select h.submission_id, h.session_id, h.path, h.place, h.final_len, arg_max(e.size, e.t) as before_len from h join ev e on e.submission_id = h.submission_id and e.session_id = h.session_id and e.path = h.path where e.kind <> 'session.heartbeat' and e.t <= h.t0 group by all)
    select submission_id, 'idle_then_complete' as heuristic_id, 'high' as severity, 0.8::double as confidence, session_id, path, place from j where before_len < 0.5 * final_len""",
)
def e08(t):
    e = ev(t).withColumn("kind", F.expr(SAVED)).withColumn("final_len", F.max("size").over(W.partitionBy("submission_id", "path"))).withColumn("len", F.col("size"))
    e = e.withColumn("final_sha", F.lit(1)).withColumn("sha", (F.col("size") >= F.col("final_len") - 100).cast("int"))
    return op.idle_then_complete(e, within_ms=60000000)


@query(
    "e09_no_errors",
    f"""{EV}, s as (select submission_id, session_id, count(*) filter (kind = 'terminal.command') as n, count(*) filter (kind = 'terminal.command' and submission_id % 3 <> 0) as failed, count(*) filter (kind = 'terminal.open') as terminals,
      count(*) filter (kind in ('doc.save', 'doc.change', 'paste')) as active, count(*) filter (kind = 'terminal.open' and k % 60 = 41 and size % 7 = 0) as hidden from ev group by 1, 2),
    g as (select submission_id, sum(n) as n, sum(failed) as failed, sum(terminals) as terminals, sum(active) as active, sum(hidden) as hidden from s group by 1)
    select submission_id, 'no_intermediate_errors' as heuristic_id, 'info' as severity, 1.0::double as confidence, session_id from s where hidden > 0
    union all select submission_id, 'no_intermediate_errors', 'medium', 0.65::double, null from g where hidden = 0 and terminals > 0 and active > 0 and failed = 0 and n >= 5""",
)
def e09(t):
    e = ev(t).withColumn("exit_code", F.when(F.col("kind") == "terminal.command", F.col("submission_id") % 3))
    return op.no_errors(e.withColumn("integrated", ~((F.col("k") % 60 == 41) & (F.col("size") % 7 == 0))))


@query("e10_known_sources", f"with {PASTES}, corpus as (select distinct 'x' || (doc_id % 50)::varchar as name, sha256(text) as sha256 from documents where doc_id % 3 = 0) select p.submission_id, 'paste_matches_known_source' as heuristic_id, 'high' as severity, 0.95::double as confidence, global_idx as place, name from pastes p join corpus using (sha256)")
def e10(t):
    d = t.raw("documents").where("doc_id % 3 = 0").select(F.concat(F.lit("x"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.sha2("text", 256).alias("sha256")).distinct()
    return op.known_sources(t.pastes().withColumn("place", F.col("global_idx")), d.withColumn("block", F.lit(None).cast("string")))


def in_sentences(text):
    """Short lines, so that texts of a few edits share most of them."""
    return F.regexp_replace(text, r"([.,;!?]) ", "$1\n")


@query("e10_similar_sources")
def e10_similar(t):
    """Documents with an id divisible by three as blocks; pastes are all documents."""
    d = t.raw("documents").where("doc_id % 3 = 0").select(F.concat(F.lit("x"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.sha2(in_sentences("text"), 256).alias("sha256"), in_sentences("text").alias("block"))
    p = t.pastes().withColumn("content", in_sentences("content")).withColumn("sha256", F.sha2("content", 256))
    return op.known_sources(p.withColumn("place", F.col("global_idx")), d)


@query("e11_corpus_lint", "with c as (select item_id as index, case when item_id % 5 = 0 then ' ' else 'n' end as name, case when item_id % 3 = 0 then null when item_id % 7 = 0 then 'zz' else sha256(text) end as sha256, item_id % 6 = 3 as none from benchmark) select index, case when trim(name) = '' then 'no_name' when sha256 is not null and not regexp_matches(sha256, '^[0-9a-f]{64}$') then 'bad_hash' else 'empty' end as error from c where trim(name) = '' or (sha256 is not null and not regexp_matches(sha256, '^[0-9a-f]{64}$')) or (sha256 is null and none)")
def e11(t):
    i = F.col("item_id")
    return op.corpus_errors(t.raw("benchmark").select(i.alias("index"), F.when(i % 5 == 0, " ").otherwise("n").alias("name"), F.when(i % 3 != 0, F.when(i % 7 == 0, "zz").otherwise(F.sha2("text", 256))).alias("sha256"), F.when(i % 6 != 3, F.split("text", "\n")).alias("lines")))


EXT = "case k % 5 when 0 then 'GitHub.copilot' when 1 then 'acme.ai-helper' when 2 then 'lint.mail' else 'zed.theme' || (k % 6)::varchar end"


def ext(t):
    return ev(t).withColumn("extension", F.expr("case k % 5 when 0 then 'GitHub.copilot' when 1 then 'acme.ai-helper' when 2 then 'lint.mail' else concat('zed.theme', k % 6) end"))


@query("e12_ai_extension", f"{EV}, x as (select *, {EXT} as extension from ev) select submission_id, 'ai_extension_active' as heuristic_id, 'info' as severity, case when extension = 'GitHub.copilot' then 0.9 else 0.6 end::double as confidence, session_id, extension, min(global_idx) as place from x where extension in ('GitHub.copilot', 'acme.ai-helper') group by submission_id, session_id, extension")
def e12(t):
    return op.ai_extensions(ext(t))


@query("e13_shell_integration", f"{EV} select submission_id, 'shell_integration_disabled' as heuristic_id, 'info' as severity, 1.0::double as confidence, session_id, global_idx as place from ev where kind = 'terminal.open' and k % 40 = 1")
def e13(t):
    return op.shell_integration_off(ev(t).where("kind = 'terminal.open'").withColumn("integrated", F.col("k") % 40 != 1))


@query("e14_extension_set_changed", f"{EV}, x as (select *, {EXT} as extension from ev) select submission_id, 'extension_set_changed_mid_assignment' as heuristic_id, 'medium' as severity, 0.85::double as confidence, session_id, extension, min(global_idx) as place from x where kind = 'paste' and not exists (select 1 from x s where s.submission_id = x.submission_id and s.session_id = x.session_id and s.extension = x.extension and s.kind = 'doc.open') group by submission_id, session_id, extension")
def e14(t):
    return op.extension_set_changes(ext(t).where("kind = 'paste'"), ext(t).where("kind = 'doc.open'"))


@query("e15_terminal_during_external", f"{EV}, x as (select *, min(case when kind = 'terminal.open' then t end) over (partition by submission_id, session_id) as first from ev) select submission_id, 'terminal_active_during_external_change' as heuristic_id, 'info' as severity, 0.6::double as confidence, session_id, global_idx as place from x where kind = 'fs.external_change' and first <= t")
def e15(t):
    return op.terminal_during_external_change(ev(t))


@query(
    "e16_clock_jumps",
    f"{EV}, g as (select submission_id, session_id, max(abs((k - 50) * 10000)) as most, count(*) as n, arg_max((k - 50) * 10000, row(abs((k - 50) * 10000), k)) as delta_ms from ev where kind = 'clock.skew' group by 1, 2) select submission_id, 'clock_jumps' as heuristic_id, 'medium' as severity, 0.8::double as confidence, session_id, delta_ms from g where most > 300000 or n >= 2",
)
def e16(t):
    return op.clock_jumps(ev(t).where("kind = 'clock.skew'").withColumn("delta_ms", (F.col("k") - 50) * 10000))


@query(
    "e17_heartbeat_gaps",
    f"""{EV}, x as (select *, case when kind = 'focus.change' then 'session.end' else kind end as kd from ev), b as (select *, lead(ms) over w as ms1, lead(global_idx) over w as g1 from x where kd = 'session.heartbeat' window w as (partition by submission_id, session_id order by global_idx))
    select submission_id, 'gap_in_heartbeats' as heuristic_id, 'medium' as severity, 0.75::double as confidence, session_id, global_idx as place from b where ms1 - ms > 300000
      and not exists (select 1 from x e where e.submission_id = b.submission_id and e.session_id = b.session_id and e.kd = 'session.end' and e.global_idx > b.global_idx and e.global_idx < b.g1)
      and exists (select 1 from x e where e.submission_id = b.submission_id and e.session_id = b.session_id and e.global_idx > b.global_idx and e.global_idx < b.g1 and e.ms > b.ms + 1000 and e.ms < b.ms1 - 1000)""",
)
def e17(t):
    return op.heartbeat_gaps(ev(t).withColumn("kind", F.when(F.col("kind") == "focus.change", "session.end").otherwise(F.col("kind"))))


@query("e19_extension_hash", f"{EV} select distinct submission_id, 'extension_hash_mismatch' as heuristic_id, 'medium' as severity, 0.9::double as confidence, 'h' || (k % 20)::varchar as extension_hash from ev where k % 20 not in (select p_size % 15 from part)")
def e19(t):
    o = ev(t).select("submission_id", F.concat(F.lit("h"), (F.col("k") % 20).cast("string")).alias("extension_hash"))
    return op.extension_hash_mismatch(o, t.raw("part").select(F.concat(F.lit("h"), (F.col("p_size") % 15).cast("string")).alias("extension_hash")).distinct())


@query("e21_merged_and_written", f"{EV}, m as (select submission_id, min(global_idx) as first from ev where kind = 'git.event' group by 1) select submission_id, path, coalesce(sum(size) filter (kind = 'git.event'), 0)::bigint as merged_in, coalesce(sum(size) filter (kind <> 'git.event' and global_idx > first), 0)::bigint as written_after from ev left join m using (submission_id) group by 1, 2")
def e21(t):
    e = ev(t)
    return op.merged_and_written(e.select("submission_id", "path", F.col("global_idx").alias("event_seq"), F.col("size").alias("length")), e.where("kind = 'git.event'"))


@query("e22_reviewed_paths", f"{EV} select submission_id, path, global_idx from ev where submission_id % 4 = 0 or path in ('f1.py', 'f2.py')")
def e22(t):
    e = ev(t).select("submission_id", "path", "global_idx")
    return op.reviewed_only(e, e.where("path in ('f1.py', 'f2.py')"), e.where("submission_id % 4 <> 0"))


@query("e23_capture_policy", f"with {FLAGS} select submission_id, heuristic_id, severity from flags where not (submission_id % 6 = 0 and heuristic_id in ('h1', 'h2', 'h3'))")
def e23(t):
    policy = t.submissions().select(F.col("id").alias("submission_id"), F.lit(True).alias("verified"), (F.col("id") % 6 != 0).alias("terminal"))
    return op.capture_gate(t.flags(), policy, ["h1", "h2", "h3"]).select("submission_id", "heuristic_id", "severity")


@query("e24_flag_order", f"with {FLAGS} select submission_id, line, part, supp, row_number() over (partition by submission_id order by case severity when 'info' then 0 when 'low' then 1 when 'medium' then 2 else 3 end desc, confidence desc, part, heuristic_id, line, supp) as place_in_report from flags")
def e24(t):
    f = t.flags().withColumn("first_key", F.struct("part", "heuristic_id", "line", "supp"))
    return op.in_order(f).select("submission_id", "line", "part", "supp", "place_in_report")
