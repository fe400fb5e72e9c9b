"""Queries of lineage, order and contributors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import event_index, rules
from ..operators import lineage as op
from ..operators.reachability import Index
from ..sources.adapters import COMMITS, EVENTS
from .registry import query

EV = f"with {EVENTS}"
CLOSURE = f"with recursive {COMMITS.strip()}, closure(node, ancestor) as (select node, parent from commits union select c.node, k.parent from closure c join commits k on k.node = c.ancestor)"


def closure(t):
    return op.ancestors(t.commits())


def index(t):
    """All commits are of one repository."""
    return Index(t.commits().withColumn("repository", F.lit(0)))


@query(
    "f01_graph_nodes",
    f"""with {COMMITS}, o as (select node % 3 as repository, node as sha, list_sort(list(parent)) as parents from commits group by 1, 2),
    obs as (select * from o union all select repository, sha, case when sha % 11 = 0 then [sha - 1] else parents end from o where sha % 2 = 0),
    own as (select repository, sha, count(*) as observations, count(distinct parents) as versions from obs group by 1, 2),
    ch as (select repository, parent as sha, count(*) as children from (select distinct repository, sha, unnest(parents) as parent from obs) group by 1, 2)
    select repository, sha, coalesce(observations, 0) as observations, case when observations is null then 'unrecorded' when versions > 1 then 'conflicting' else 'recorded' end as parents, coalesce(children, 0) as children from own full join ch using (repository, sha)""",
)
def f01(t):
    o = t.commits().groupBy((F.col("node") % 3).alias("repository"), F.col("node").alias("sha")).agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    again = o.where("sha % 2 = 0").withColumn("parents", F.when(F.col("sha") % 11 == 0, F.array(F.col("sha") - 1)).otherwise(F.col("parents")))
    return op.graph_nodes(o.unionAll(again))


BACK = "select node, parent from commits union all select node // 8, node from commits where node % 40 = 8"


@query("f02_cycles", CLOSURE.replace("select node, parent from commits union", f"select * from ({BACK}) union").replace("join commits k", f"join ({BACK}) k") + " select a.node, min(a.ancestor) as cycle from closure a join closure b on a.node = b.ancestor and a.ancestor = b.node group by 1")
def f02(t):
    c = t.commits()
    back = c.where("node % 40 = 8").select(F.floor(F.col("node") / 8).alias("node"), F.col("node").alias("parent"))
    return op.cyclic_nodes(c.unionAll(back))


@query("f03_ancestors", f"{CLOSURE} select distinct node, ancestor from closure")
def f03(t):
    return closure(t)


PAIRS = "pairs as (select distinct p_partkey as a, (p_partkey * 7 + 3) % 2100 as b from part)"


@query(
    "f03_commit_comparison",
    f"{CLOSURE}, {PAIRS}, known as (select node from commits union select parent from commits) select a, b, case when a not in (select node from known) or b not in (select node from known) then 'unknown' when a = b then 'same' when exists (select 1 from closure c where c.node = b and c.ancestor = a) then 'before' when exists (select 1 from closure c where c.node = a and c.ancestor = b) then 'after' else 'unordered' end as verdict from pairs",
)
def f03_compare(t):
    pairs = t.raw("part").select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 3) % 2100).alias("b")).distinct()
    return index(t).compared(pairs.withColumn("repository", F.lit(0))).drop("repository")


RANKED = f"{CLOSURE}, n as (select node, count(*) as ancestors from (select distinct node, ancestor from closure) group by 1), r as (select p_partkey % 40 as submission_id, p_partkey as node, coalesce(ancestors, 0) as ancestors, row_number() over (partition by p_partkey % 40 order by coalesce(ancestors, 0), p_partkey) as place from part left join n on n.node = p_partkey)"


def ranked(t):
    nodes = t.raw("part").select((F.col("p_partkey") % 40).alias("submission_id"), F.col("p_partkey").alias("node"))
    return op.presentation_order(nodes, index(t).ancestor_counts(nodes.select(F.lit(0).alias("repository"), "node").distinct()))


@query("b23_presentation_order", f"{RANKED} select * from r")
def b23(t):
    return ranked(t)


@query("b24_order_breaks", f"{RANKED}, l as (select *, lag(node) over (partition by submission_id order by place) as before from r) select submission_id, place, before, node from l where before is not null and not exists (select 1 from closure c where c.node = l.node and c.ancestor = l.before)")
def b24(t):
    from pyspark.sql.window import Window as W

    r = ranked(t).withColumn("before", F.lag("node").over(W.partitionBy("submission_id").orderBy("place"))).where("before is not null")
    v = index(t).compared(r.select(F.lit(0).alias("repository"), F.col("before").alias("a"), F.col("node").alias("b")).distinct())
    j = r.join(v, (v["a"] == r["before"]) & (v["b"] == r["node"]))
    return event_index.order_breaks(j).select("submission_id", "place", "before", "node")


LINKS = """s as (select o_custkey % 50 as submission_id, 's' || o_orderkey::varchar as session_id, case o_orderkey % 6 when 0 then null when 1 then 's' || (o_orderkey + 1)::varchar when 2 then 's' || (o_orderkey - 1)::varchar when 3 then 'x' || o_orderkey::varchar when 4 then 's' || o_orderkey::varchar else 's' || (o_orderkey // 2)::varchar end as prev_session_id from orders)"""


def links(t):
    k = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    prev = F.when(k % 6 == 1, name(k + 1)).when(k % 6 == 2, name(k - 1)).when(k % 6 == 3, F.concat(F.lit("x"), k.cast("string"))).when(k % 6 == 4, name(k)).when(k % 6 == 5, name(F.floor(k / 2)))
    return t.raw("orders").select((F.col("o_custkey") % 50).alias("submission_id"), name(k).alias("session_id"), prev.alias("prev_session_id"))


@query(
    "f05_ordering_defects",
    f"""with {LINKS}, j as (select a.submission_id, a.session_id, case when b.prev_session_id = a.session_id or a.prev_session_id = a.session_id then 'cyclic' when a.prev_session_id not in (select session_id from s) then 'dangling' when b.session_id is null then 'foreign' end as defect
      from s a left join s b on b.submission_id = a.submission_id and b.session_id = a.prev_session_id where a.prev_session_id is not null) select * from j where defect is not null""",
)
def f05(t):
    return op.ordering_defects(links(t))


CLASSES = f"""{EV}, ch as (select submission_id, session_id, ms, global_idx as place, case when k % 10 <> 0 then size % 50 end as sha from ev where kind = 'fs.external_change'),
con as (select distinct submission_id, session_id as other, size % 50 as sha from ev where kind = 'git.event'),
classes as (select c.submission_id, c.session_id, c.place, case when c.sha is null then 'unclassified'
    when (select count(*) from con where con.submission_id = c.submission_id and con.sha = c.sha and other <> c.session_id) > 0 then 'git_merge_in'
    when c.ms - (select max(ms) from ev g where g.submission_id = c.submission_id and g.session_id = c.session_id and g.kind = 'focus.change' and g.ms <= c.ms) <= 60000000 then 'git_unrecorded_in' else 'external' end as class,
    (select count(*) from con where con.submission_id = c.submission_id and con.sha = c.sha and other <> c.session_id) as matches from ch c)"""


def classes(t):
    e = t.events()
    ch = e.where("kind = 'fs.external_change'").select("submission_id", "session_id", "ms", F.col("global_idx").alias("place"), F.when(F.col("k") % 10 != 0, F.col("size") % 50).alias("sha"))
    con = e.where("kind = 'git.event'").select("submission_id", "session_id", (F.col("size") % 50).alias("sha"))
    return op.external_classes(ch, con, e.where("kind = 'focus.change'"), 60000000)


@query("f06_external_classes", f"{CLASSES} select * from classes")
def f06(t):
    return classes(t)


@query("f07_class_counts", f"{CLASSES} select submission_id, class, count(*) as n from classes group by 1, 2")
def f07(t):
    return classes(t).groupBy("submission_id", "class").agg(F.count(F.lit(1)).alias("n"))


RANGES = f"""{EV}, x as (select *, case when kind = 'focus.change' then 'session.end' else kind end as kd from ev),
ranges as (select submission_id, session_id, min(ms) as start_ms, greatest(min(ms), coalesce(max(ms) filter (kd = 'session.end'), max(ms))) as stop_ms, max(ms) filter (kd = 'session.end') is null as open_ended from x group by 1, 2)"""


def ranges(t):
    return op.session_ranges(t.events().withColumn("kind", F.when(F.col("kind") == "focus.change", "session.end").otherwise(F.col("kind"))))


@query("f08_session_ranges", f"{RANGES} select * from ranges")
def f08(t):
    return ranges(t)


# Sessions of five users as one submission, as if they had worked together.
OVERLAPS = f"""{RANGES}, r as (select submission_id // 5 as submission_id, session_id, start_ms, stop_ms, case when submission_id % 5 <> 0 then submission_id % 3 end as contributor, case when submission_id % 2 = 0 then submission_id % 4 end as machine from ranges),
overlapping as (select a.submission_id, a.session_id as session_a, b.session_id as session_b, case when a.machine = b.machine then 'same_machine' when a.contributor is null or b.contributor is null then 'unknown' when a.contributor <> b.contributor then 'collaboration' else 'multi_machine' end as judgement,
    least(a.stop_ms, b.stop_ms) - greatest(a.start_ms, b.start_ms) as overlap_ms from r a join r b on a.submission_id = b.submission_id and a.session_id < b.session_id and a.start_ms < b.stop_ms and b.start_ms < a.stop_ms)"""


def overlaps(t):
    s = F.col("submission_id")
    r = ranges(t).select(F.floor(s / 5).alias("submission_id"), "session_id", "start_ms", "stop_ms", F.when(s % 5 != 0, s % 3).alias("contributor"), F.when(s % 2 == 0, s % 4).alias("machine"))
    return op.session_overlaps(r)


@query("f09_session_overlaps", f"{OVERLAPS} select * from overlapping")
def f09(t):
    return overlaps(t)


@query("e18_session_overlap_flags", f"{OVERLAPS} select submission_id, 'multiple_sessions_overlap' as heuristic_id, case when judgement = 'multi_machine' then 'high' else 'low' end as severity, case when judgement = 'multi_machine' then 0.95 else 0.5 end::double as confidence, session_a, session_b from overlapping where judgement in ('multi_machine', 'unknown')")
def e18(t):
    return rules.session_overlap_flags(overlaps(t))


@query(
    "f10_witnesses",
    f"""{EV}, l as (select session_id, seq, sha256(session_id || seq::varchar) as hash, submission_id % 3 as contributor from ev), last as (select session_id, max(seq) as last_seq, min(contributor) as owner from l group by 1),
    o as (select k % 3 as observer, case when k % 13 = 0 then 'gone' else session_id end as session_id, case when k % 17 = 0 then null else seq + case when k % 7 = 0 then 500 else 0 end end as seq_high, case when k % 11 = 0 then sha256('x') when k % 19 = 0 then 'short' else sha256(session_id || seq::varchar) end as last_hash from ev where kind = 'paste')
    select observer, o.session_id, seq_high, case when seq_high is null or not regexp_matches(last_hash, '^[0-9a-f]{{64}}$') then 'malformed' when owner = observer then 'excluded_own' when last_seq is null then 'absent' when seq_high > last_seq then 'short' when hash is null then 'indeterminate' when hash <> last_hash then 'tip_mismatch' else 'corroborated' end as verdict
    from o left join last using (session_id) left join l on l.session_id = o.session_id and l.seq = o.seq_high""",
)
def f10(t):
    e, k = t.events(), F.col("k")
    hash_ = F.sha2(F.concat("session_id", F.col("seq").cast("string")), 256)
    seen = e.where("kind = 'paste'").select((k % 3).alias("observer"), F.when(k % 13 == 0, "gone").otherwise(F.col("session_id")).alias("session_id"), F.when(k % 17 != 0, F.col("seq") + F.when(k % 7 == 0, 500).otherwise(0)).alias("seq_high"), F.when(k % 11 == 0, F.sha2(F.lit("x"), 256)).when(k % 19 == 0, "short").otherwise(hash_).alias("last_hash"))
    return op.reconciled_witnesses(seen, e.select("session_id", "seq", hash_.alias("hash"), (F.col("submission_id") % 3).alias("contributor")))


SESSIONS = f"{EV}, ss as (select distinct submission_id // 5 as submission_id, session_id, case when submission_id % 7 <> 0 then 'c' || (submission_id % 3)::varchar end as contributor_key, ['attributed', 'unverifiable', 'unattributed'][submission_id % 3 + 1] as contributor_kind from ev)"


def sessions(t):
    s = F.col("submission_id")
    kinds = F.array(*map(F.lit, ("attributed", "unverifiable", "unattributed")))
    return t.events().select(F.floor(s / 5).alias("submission_id"), "session_id", F.when(s % 7 != 0, F.concat(F.lit("c"), (s % 3).cast("string"))).alias("contributor_key"), F.get(kinds, (s % 3).cast("int")).alias("contributor_kind")).distinct()


@query("f11_contributors", f"{SESSIONS} select submission_id, contributor_key, count(*) as sessions, " + ", ".join(f"count(*) filter (contributor_kind = '{k}') as n_{k}" for k in ("attributed", "unverifiable", "unattributed")) + " from ss where contributor_key is not null group by 1, 2")
def f11(t):
    return op.contributor_table(sessions(t))


@query(
    "f12_contributors_on_roster",
    "with c as (select distinct l_orderkey as submission_id, 'k' || (l_suppkey % 5)::varchar as contributor_key, l_suppkey % 5 as ref from lineitem), s as (select distinct l_orderkey as submission_id, l_partkey % 5 as ref from lineitem) select submission_id, contributor_key, ref, s.submission_id is not null as is_submitter from c left join s using (submission_id, ref) union all select submission_id, 'roster-' || ref::varchar, ref, true from s where (submission_id, ref) not in (select submission_id, ref from c)".replace("s.submission_id is not null as is_submitter from c left join s using (submission_id, ref)", "(submission_id, ref) in (select submission_id, ref from s) as is_submitter from c"),
)
def f12(t):
    li = t.raw("lineitem")
    c = li.select(F.col("l_orderkey").alias("submission_id"), F.concat(F.lit("k"), (F.col("l_suppkey") % 5).cast("string")).alias("contributor_key"), (F.col("l_suppkey") % 5).alias("ref")).distinct()
    return op.contributors_on_roster(c, li.select(F.col("l_orderkey").alias("submission_id"), (F.col("l_partkey") % 5).alias("roster_id")).distinct())


@query("f13_attributed_flags", f"{SESSIONS}, f as (select submission_id // 5 as submission_id, case when k % 4 = 0 then '' else session_id end as session_id, global_idx, submission_id as s0 from ev where kind = 'paste') select f.submission_id, f.session_id, s0, global_idx, coalesce(contributor_key, '') as contributor_key from f left join ss using (submission_id, session_id)")
def f13(t):
    e = t.events().where("kind = 'paste'").select(F.floor(F.col("submission_id") / 5).alias("submission_id"), F.when(F.col("k") % 4 == 0, "").otherwise(F.col("session_id")).alias("session_id"), F.col("submission_id").alias("s0"), "global_idx")
    return op.attributed_flags(e, sessions(t)).select("submission_id", "session_id", "s0", "global_idx", "contributor_key")


@query(
    "f14_capabilities",
    f"""{EV}, x as (select *, case when kind = 'git.event' and submission_id % 3 = 0 then 'none' else kind end as kd from ev), s as (select submission_id, session_id, count(*) filter (kd = 'git.event') as git, count(distinct path) as files from x group by 1, 2)
    select submission_id, case when sum(git) > 0 then 'available' when submission_id % 2 = 0 then 'impossible' else 'unknown' end as git, sum(git)::bigint as git_events, count(*) filter (git = 0) as silent_sessions, max(files) as watched_files from s group by 1""",
)
def f14(t):
    e = t.events().withColumn("kind", F.when((F.col("kind") == "git.event") & (F.col("submission_id") % 3 == 0), "none").otherwise(F.col("kind")))
    return op.capabilities(e.withColumn("git_possible", F.col("submission_id") % 2 != 0))
