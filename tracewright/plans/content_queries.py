"""Queries of replay, file statistics, path scopes and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contents as op
from ..operators import moves, rules, similarity
from ..sources.adapters import EVENTS, FLAGS, PASTES, SUBMISSIONS, TURNS
from .registry import query

EV = f"with {EVENTS}"


def edits(t):
    """Appending edits of one file per conversation."""
    null = F.lit(None).cast("int")
    return t.turns().select("submission_id", F.lit("main.py").alias("path"), F.col("seq").alias("global_idx"), "kind", F.col("text").alias("content"), *[null.alias(c) for c in ("start_line", "start_char", "end_line", "end_char")])


OPENED = f"with {TURNS}, first as (select submission_id, max(seq) filter (kind = 'doc.open') as o from turns group by 1), kept as (select t.* from turns t join first f using (submission_id) where seq >= coalesce(o, -1))"


@query("c01_replay", f"{OPENED} select submission_id, 'main.py' as path, string_agg(text, '' order by seq) as content, sha256(string_agg(text, '' order by seq)) as sha256 from kept group by 1")
def c01(t):
    return op.replay(edits(t)).select("submission_id", "path", "content", "sha256")


@query("c02_replay_as_of", f"{OPENED}, cut as (select submission_id, max(seq) as cut from turns group by 1) select c.submission_id, c.cut as global_idx, coalesce(string_agg(text, '' order by seq), '') as content from cut c left join kept k on k.submission_id = c.submission_id and k.seq < c.cut group by 1, 2")
def c02(t):
    e = edits(t)
    cuts = e.groupBy("submission_id", "path").agg(F.max("global_idx").alias("cut"))
    return op.replay(e, cuts).select("submission_id", "global_idx", "content")




@query("c03_origin_runs", f"{OPENED}, n as (select submission_id, seq, length(text) as len from kept where text <> '') select submission_id, seq as event_seq, (coalesce(sum(len) over (partition by submission_id order by seq rows between unbounded preceding and 1 preceding), 0))::int as \"offset\", len::int as length from n")
def c03(t):
    s = op.replay(edits(t))
    return op.run_table(s, t.events()).select("submission_id", "event_seq", "offset", "length")


@query("c04_snapshots")
def c04(t):
    e = edits(t)
    inner = e.withColumn("start_line", F.when(F.col("kind") != "doc.open", F.lit(0))).withColumn("start_char", F.when(F.col("kind") != "doc.open", F.lit(0)))
    inner = inner.withColumn("end_line", F.col("start_line")).withColumn("end_char", F.col("start_char"))
    return op.replay(inner, e.select("submission_id", "path", F.col("global_idx").alias("cut"))).select("submission_id", "global_idx", "sha256", "length", "tainted")


@query("c08_runs_with_kind", f"{OPENED} select submission_id, kind, sum(length(text))::bigint as chars from kept where text <> '' group by 1, 2")
def c08(t):
    e = edits(t)
    r = op.run_table(op.replay(e), e.select("submission_id", "global_idx", "kind"))
    return r.groupBy("submission_id", "kind").agg(F.sum("length").cast("long").alias("chars"))


@query("c09_line_origins")
def c09(t):
    return op.line_origins(op.replay(edits(t)))


@query("c05_recovered_pastes", f"with {PASTES} select p.submission_id, p.global_idx, arg_max(b.content, b.global_idx) as content from pastes p join pastes b using (submission_id, sha256) where b.global_idx < p.global_idx group by 1, 2")
def c05(t):
    p = t.pastes()
    big = p.select("submission_id", "global_idx", "sha256", F.substring("content", 1, 20).alias("head"), F.expr("substring(content, -10)").alias("tail"), F.octet_length("content").alias("bytes"))
    return op.recovered_pastes(big, p)


SAVES = f"{EV}, x as (select *, case when kind = 'session.heartbeat' then 'doc.save' else kind end as kd, size % 3 as sha from ev)"


def saves(t):
    return t.events().withColumn("kind", F.when(F.col("kind") == "session.heartbeat", "doc.save").otherwise(F.col("kind"))).withColumn("sha256", F.col("size") % 3)


@query(
    "c06_self_inflicted",
    f"""{SAVES}, y as (select *, first_value(case when kd in ('doc.save', 'doc.change', 'paste') then kd || '|' || sha::varchar || '|' || ms::varchar end ignore nulls) over (partition by submission_id, session_id, path order by global_idx rows between 1 following and unbounded following) as nxt,
      last_value(case when kd = 'doc.save' then sha end ignore nulls) over (partition by submission_id, session_id, path order by global_idx rows between unbounded preceding and 1 preceding) as before from x)
    select submission_id, session_id, path, global_idx from y where kd = 'fs.external_change' and ((split_part(nxt, '|', 1) = 'doc.save' and split_part(nxt, '|', 2) = sha::varchar and split_part(nxt, '|', 3)::bigint - ms <= 100000000) or before = sha)""",
)
def c06(t):
    return op.self_inflicted(saves(t), 100000000)


@query("c07_edit_derived", f"{OPENED}, f as (select submission_id, sha256(string_agg(text, '' order by seq)) as sha from kept group by 1) select submission_id from f where submission_id % 3 <> 0")
def c07(t):
    s = op.replay(edits(t)).select("submission_id", "sha256")
    claimed = s.select("submission_id", F.when(F.col("submission_id") % 3 != 0, F.col("sha256")).otherwise("0").alias("claimed"))
    return s.join(claimed, "submission_id").where("sha256 = claimed").select("submission_id")


STATS = f"{EV}, st as (select submission_id, path, coalesce(sum(length(kind || k::varchar)) filter (kind = 'doc.change'), 0)::bigint as typed, coalesce(sum(length(kind || k::varchar)) filter (kind = 'paste'), 0)::bigint as pasted, coalesce(sum(size) filter (kind = 'fs.external_change'), 0)::bigint as external, count(*) filter (kind = 'doc.save') as saves from ev group by 1, 2)"


def stats(t):
    return op.file_stats(t.events().withColumn("text", F.concat("kind", F.col("k").cast("string"))).withColumn("diff_size", F.col("size")))


@query("c10_file_stats", f"{STATS} select * from st")
def c10(t):
    return stats(t)


@query("c11_active_time", f"{EV}, g as (select submission_id, ms - lag(ms) over (partition by submission_id order by global_idx) as gap from ev) select submission_id, coalesce(sum(gap) filter (gap < 6000000), 0)::bigint as active_ms, coalesce(sum(gap) filter (gap >= 6000000), 0)::bigint as idle_ms from g where gap >= 0 group by 1")
def c11(t):
    return op.active_time(t.events(), 6000000)


@query("c12_terminal_spans")
def c12(t):
    e = t.events().where("kind in ('terminal.open', 'terminal.command', 'doc.open')").withColumn("terminal", F.col("k") % 2)
    return op.terminal_spans(e.withColumn("kind", F.when(F.col("kind") == "terminal.open", "terminal.open").otherwise("terminal.close")))


@query("c13_start_lengths", f"with {PASTES} select submission_id, 'f' || (global_idx % 5)::varchar as path, coalesce(length(arg_min(content, global_idx)), 0)::bigint as start_length from pastes group by 1, 2")
def c13(t):
    p = t.pastes().withColumn("path", F.concat(F.lit("f"), (F.col("global_idx") % 5).cast("string")))
    return op.start_lengths(p)


@query("c14_stats_rollup", f"{STATS}, s as (select submission_id, session_id, count(*) as n, max(ms) - min(ms) as span from ev group by 1, 2), a as (select submission_id, sum(n)::bigint as events, count(*) as sessions, sum(span)::bigint as span_ms from s group by 1) select submission_id, sum(typed)::bigint as typed, sum(pasted)::bigint as pasted, sum(saves)::bigint as saves, count(*) as files, any_value(events) as events, any_value(sessions) as sessions, any_value(span_ms) as span_ms from st join a using (submission_id) group by 1")
def c14(t):
    return op.stats_rollup(stats(t), t.events())


PATHS = "paths as (select distinct page_id % 5 as submission_id, case when page_id % 17 = 0 then '.recording/x' else regexp_replace(url, '^https?://[^/]*/', '') end as path from pages)"
RULES = [("track", "en/"), ("track", "fr/12"), ("ignore", "*x=f"), ("ignore", "de/"), ("attachments", "*ref=x"), ("attachments", "es/")]


def paths(t):
    p = F.col("page_id")
    return t.raw("pages").select((p % 5).alias("submission_id"), F.when(p % 17 == 0, ".recording/x").otherwise(F.regexp_replace("url", "^https?://[^/]*/", "")).alias("path")).distinct()


@query(
    "c17_path_roles",
    f"""with {PATHS}, r(list, entry) as (values {", ".join(map(str, RULES))}), m as (select submission_id, path, min(case when path like '.recording/%' then 1 when path = entry or (entry like '%/' and starts_with(path, entry)) or (entry like '*%' and ends_with(path, entry[2:])) then case list when 'ignore' then 2 when 'attachments' then 3 else 4 end end) as f from paths, r where submission_id <> 4 group by 1, 2 union all select submission_id, path, case when path like '.recording/%' then 1 end from paths where submission_id = 4)
    select submission_id, path, case f when 1 then 'excluded' when 2 then 'ignored' when 3 then 'attachment' when 4 then 'reviewed' else 'unscoped' end as role from m""",
)
def c17(t):
    p = paths(t)
    listed = p.where("submission_id <> 4").select("submission_id").distinct()
    rows = F.array(*[F.struct(F.lit(a).alias("list"), F.lit(b).alias("entry")) for a, b in RULES])
    return op.path_roles(p, listed.select("submission_id", F.inline(rows)), ".recording/")


@query(
    "c18_scope_lint",
    """with e as (select p_partkey, case p_partkey % 9 when 0 then '' when 1 then '/' || p_name when 2 then 'a/../' || p_name when 3 then 'a//' || p_name when 4 then '*' when 5 then 'x*' || p_name when 6 then '*.py' when 7 then 'src/' else 'C:' || p_name end as entry from part)
    select p_partkey, entry, case p_partkey % 9 when 0 then 'empty' when 1 then 'absolute' when 2 then 'dot_segment' when 3 then 'empty_segment' when 4 then 'bad_wildcard' when 5 then 'bad_wildcard' else 'absolute' end as problem from e where p_partkey % 9 not in (6, 7)""",
)
def c18(t):
    e = F.expr("case p_partkey % 9 when 0 then '' when 1 then concat('/', p_name) when 2 then concat('a/../', p_name) when 3 then concat('a//', p_name) when 4 then '*' when 5 then concat('x*', p_name) when 6 then '*.py' when 7 then 'src/' else concat('C:', p_name) end")
    return op.scope_problems(t.raw("part").select("p_partkey", e.alias("entry")))


# Similarity


@query("g01_paste_features", f"{EV} select submission_id, global_idx, path, size * 3 as length, sha256(size::varchar) as sha256, size::varchar as content from ev where kind = 'paste'")
def g01(t):
    e = t.events().withColumn("length", F.col("size") * 3).withColumn("content", F.col("size").cast("string"))
    return similarity.paste_features(e.withColumn("sha256", F.sha2("content", 256)))


@query("g02_exact_shared", f"with {PASTES} select sha256, count(*) as pastes, count(distinct submission_id) as submissions from pastes group by 1 having count(distinct submission_id) >= 2")
def g02(t):
    return similarity.exact_shared(t.pastes())


def lined(t):
    """Pastes in short lines, so that texts of a few edits share most of them."""
    return t.pastes().withColumn("content", F.regexp_replace("content", r"([.,;!?]) ", "$1\n")).withColumn("sha256", F.sha2("content", 256))


@query("g03_line_matches")
def g03(t):
    return similarity.line_matches(lined(t))


def groups(t):
    return similarity.greedy_groups(lined(t), similarity.line_matches(lined(t)))


@query("g04_shared_paste_flags")
def g04(t):
    return similarity.shared_paste_flags(groups(t))


#: Customers as submissions; neighbouring orders share a sha, in one of two repositories or in none that is named.
HELD = """with recursive c as (select distinct o_custkey as submission_id, case o_orderkey % 3 when 1 then 'r1' when 2 then 'r2' end as repository, 'c' || (o_orderkey // 2)::varchar as sha from orders where o_orderkey % 16 < 2),
s as (select distinct o_custkey as submission_id, case when o_orderkey % 5 = 4 then 'all' else 's' || (o_orderkey // 3)::varchar end as key from orders where o_orderkey % 24 < 3 or o_orderkey % 5 = 4),
pool as (select c_custkey as submission_id from customer),
one as (select sha, max(repository) as real from c group by 1 having count(distinct repository) = 1 and count(*) filter (repository is null) > 0),
every as (select 'commit' as kind, coalesce(repository, '?') || ' ' || sha as key, submission_id from c union select 'bridge', real || ' ' || sha, submission_id from c join one using (sha) union select 'session', key, submission_id from s),
proof as (select kind, key from every group by 1, 2 having count(*) > 1 and (kind <> 'session' or (select count(*) from pool) < 5 or 2 * count(*) < (select count(*) from pool))),
k as (select every.* from every join proof using (kind, key)),
e as (select distinct a.submission_id as x, b.submission_id as y from k a join k b using (kind, key) where a.submission_id <> b.submission_id),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on e.x = r.y),
lines as (select submission_id, least(submission_id, coalesce(min(y), submission_id)) as lineage from pool left join r on x = submission_id group by 1),
own as (select distinct lineage, case when kind = 'bridge' then 'commit' else kind end as kind, unnest(case when kind = 'bridge' then [key, '? ' || split_part(key, ' ', 2)] else [key] end) as key from k join lines using (submission_id))"""


def held(t):
    o = t.raw("orders")
    n = F.col("o_orderkey")
    commits = o.where(n % 16 < 2).select(F.col("o_custkey").alias("submission_id"), F.when(n % 3 == 1, "r1").when(n % 3 == 2, "r2").alias("repository"), F.concat(F.lit("c"), F.floor(n / 2).cast("string")).alias("sha"))
    sessions = o.where((n % 24 < 3) | (n % 5 == 4)).select(F.col("o_custkey").alias("submission_id"), F.when(n % 5 == 4, "all").otherwise(F.concat(F.lit("s"), F.floor(n / 3).cast("string"))).alias("key"))
    return commits, sessions, t.raw("customer").select(F.col("c_custkey").alias("submission_id"))


@query("g05_lineages", f"{HELD} select * from lines")
def g05(t):
    return similarity.lineages(*held(t))


@query(
    "g06_lineage_exclusions",
    f"{HELD}, g as (select lineage, count(*) as members from lines group by 1 having count(*) > 1), n as (select lineage, count(*) filter (kind = 'commit') as commits, count(*) filter (kind = 'session') as sessions from own group by 1) select lineage, case when commits > 0 then 'same_repository_lineage' else 'shared_recording_scope' end as reason, members, members * (members - 1) // 2 as pairs, commits, sessions from g join n using (lineage)",
)
def g06(t):
    h = held(t)
    return similarity.lineage_exclusions(similarity.lineages(*h), similarity.lineage_keys(*h))


@query("g06_exclusion_keys", f"{HELD} select * from own")
def g06_keys(t):
    h = held(t)
    return similarity.exclusion_keys(similarity.lineages(*h), similarity.lineage_keys(*h))


@query("g06_exclusion_members", f"{HELD} select lineage, row_number() over (partition by lineage order by c_name, submission_id) as place, submission_id, c_name as source_filename from lines join customer on c_custkey = submission_id where lineage in (select lineage from lines group by 1 having count(*) > 1)")
def g06_members(t):
    return similarity.exclusion_members(similarity.lineages(*held(t)), t.raw("customer").select(F.col("c_custkey").alias("submission_id"), F.col("c_name").alias("source_filename")))


@query(
    "g07_across_lineages",
    "with p as (select distinct l_partkey as flag_id, l_orderkey as submission_id from lineitem), g as (select flag_id from p group by 1 having min(submission_id // 10) <> max(submission_id // 10)) select * from p where flag_id in (select flag_id from g)",
)
def g07(t):
    p = t.raw("lineitem").select(F.col("l_partkey").alias("flag_id"), F.col("l_orderkey").alias("submission_id")).distinct()
    lines = p.select("submission_id", F.floor(F.col("submission_id") / 10).alias("lineage")).distinct()
    return similarity.across_lineages(p, lines)


@query("g08_cohort_groups", f"with {SUBMISSIONS}, l as (select id, assignment_id * 100 + student_id % 100 as assignment_id from subs where id % 3 <> 0 or id % 6 <> 0), n as (select *, count(*) over (partition by assignment_id) as n from l) select id, assignment_id from n where n >= 2")
def g08(t):
    s = t.submissions().withColumn("assignment_id", F.col("assignment_id") * 100 + F.col("student_id") % 100).withColumn("superseded_by", F.when(F.col("id") % 6 == 0, F.lit(1)))
    return similarity.cohort_groups(s).select("id", "assignment_id")


@query("g09_participants", f"{EV} select kind || '-' || path as flag_id, submission_id, global_idx from ev where kind in ('paste', 'git.event')")
def g09(t):
    e = t.events()
    f = e.where("kind in ('paste', 'git.event')").groupBy(F.concat_ws("-", "kind", "path").alias("flag_id"), "submission_id").agg(F.collect_list(F.concat_ws(":", "session_id", F.col("seq").cast("string"))).alias("keys"))
    return similarity.participant_rows(f, e)


CROSS = f"with {FLAGS}, p as (select distinct part as flag_id, submission_id from flags), x as (select part as flag_id, max(case severity when 'info' then 0 when 'low' then 1 when 'medium' then 2 else 3 end) as rk, max(confidence) as confidence, max(supp) as created, min(submission_id) as first_submission from flags group by 1), c as (select *, ['info', 'low', 'medium', 'high'][rk + 1] as severity from x)"


def cross(t):
    from ..operators.scoring import rank, severity_of

    g = t.flags().groupBy(F.col("part").alias("flag_id")).agg(F.max(rank("severity")).alias("rk"), F.max("confidence").alias("confidence"), F.max("supp").alias("created"), F.min("submission_id").alias("first_submission"))
    return g.withColumn("severity", severity_of(F.col("rk"))).drop("rk"), t.flags().select(F.col("part").alias("flag_id"), "submission_id").distinct()


@query("g10_cross_flag_page", f"{CROSS} select c.flag_id, severity, created, (select list(submission_id order by submission_id) from p where p.flag_id = c.flag_id) as participants from c where rk >= 2 and flag_id in (select flag_id from p where submission_id = 7) order by created desc, flag_id desc limit 11")
def g10(t):
    f, p = cross(t)
    return similarity.cross_flag_page(f, p, 10, "medium", 7).select("flag_id", "severity", "created", "participants")


@query("g10_next_flags_of_a_rule", f"{CROSS}, r as (select *, 'h' || (flag_id % 3)::varchar as heuristic_id from c) select flag_id, created, heuristic_id, (select list(submission_id order by submission_id) from p where p.flag_id = r.flag_id) as participants from r where heuristic_id = 'h1' and (created < (select max(created) // 2 from c) or (created = (select max(created) // 2 from c) and flag_id < 50)) order by created desc, flag_id desc limit 41")
def g10_next(t):
    f, p = cross(t)
    f = f.withColumn("heuristic_id", F.concat(F.lit("h"), (F.col("flag_id") % 3).cast("string")))
    half = f.agg(F.max("created")).head()[0] // 2
    return similarity.cross_flag_page(f, p, 40, rule="h1", after=(half, 50)).select("flag_id", "created", "heuristic_id", "participants")


@query("g11_exclusion_page", "with x as (select l_suppkey as lineage, list(distinct l_orderkey % 500 order by l_orderkey % 500) as members, max(l_partkey) as created from lineitem group by 1) select lineage, created from x where list_contains(members, 7) order by created desc, lineage desc limit 500")
def g11(t):
    x = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("lineage")).agg(F.sort_array(F.collect_set(F.col("l_orderkey") % 500)).alias("members"), F.max("l_partkey").alias("created"))
    return similarity.exclusion_page(x, 7).select("lineage", "created")


@query("g12_cross_order", f"{CROSS} select flag_id, flag_id % 12 as assignment_id, row_number() over (partition by flag_id % 12 order by rk desc, confidence desc, first_submission, flag_id) as place from c")
def g12(t):
    return similarity.cross_order(cross(t)[0].withColumn("assignment_id", F.col("flag_id") % 12)).select("flag_id", "assignment_id", "place")


def together(pastes):
    """All sources are one submission."""
    return pastes.withColumn("submission_id", F.lit(0).cast("long"))


@query(
    "e20_anchored_runs",
    f"""with {PASTES}, l as (select 0::bigint as submission_id, global_idx as place, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13) || chr(160))), lambda x: x <> '') as lines from pastes),
    n as (select *, ceil(len(lines) * {moves.MATCH})::int as required from l where len(lines) > 0),
    h as (select submission_id, place as source_place, lines as hay, unnest(range(1, len(lines) + 1)) as i from l where len(lines) > 0),
    m as (select n.submission_id, n.place, h.source_place, n.lines, h.hay from n join h on h.submission_id = n.submission_id and h.hay[h.i] = n.lines[1] and h.source_place < n.place and h.hay[h.i:h.i + required - 1] = n.lines[1:required]),
    f as (select submission_id, place, min(source_place) as source_place, any_value(len(lines)) as lines from m group by 1, 2)
    select * from f""",
)
def e20_runs(t):
    own = together(t.pastes().withColumn("place", F.col("global_idx")))
    return moves.anchored(own.withColumn("ord", F.lit(0)), own).select("submission_id", "place", "source_place", F.col("lines").cast("long").alias("lines"))


@query("e05_paste_is_solution")
def e05(t):
    """Documents as pastes into files that end as the document with a line more, or with as many lines again."""
    p = t.pastes().withColumn("place", F.col("global_idx"))
    more = F.when(F.col("place") % 2 == 0, F.lit("\nend")).otherwise(F.regexp_replace("content", "[^\n]+", "other"))
    final = p.withColumn("final", F.concat("content", more))
    own = together(p)
    found = moves.anchored(own.withColumn("ord", F.lit(0)), own).select("place")
    return rules.pastes_of_solution(final, found.join(p.select("place", "submission_id"), "place"))
