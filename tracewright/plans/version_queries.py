"""Queries of file versions, saves judged by replay, order of events, and files of several people."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import branches, reachability, versions
from ..sources.adapters import COMMITS, EVENTS
from .registry import query

#: Content events: opens, changes and pastes append or set a line; some carry no content; heartbeats are saves.
EDITS = f"""with {EVENTS},
c0 as (select submission_id, session_id, seq, global_idx, path, size, k, case when kind = 'session.heartbeat' then 'doc.save' else kind end as kind,
    case when kind in ('doc.open', 'fs.external_change') and k % 3 <> 0 or kind = 'doc.change' or kind = 'paste' and k % 5 <> 0 then kind || size::varchar || chr(10) end as content
    from ev where kind in ('doc.open', 'doc.change', 'paste', 'fs.external_change', 'session.heartbeat'))"""
KINDS = ("doc.open", "doc.change", "paste", "fs.external_change", "session.heartbeat")


def edits(t):
    kind, k = F.col("kind"), F.col("k")
    line = F.concat("kind", F.col("size").cast("string"), F.lit("\n"))
    content = F.when((kind.isin("doc.open", "fs.external_change") & (k % 3 != 0)) | (kind == "doc.change") | ((kind == "paste") & (k % 5 != 0)), line)
    e = t.events().where(kind.isin(*KINDS)).withColumn("content", content)
    return e.select("submission_id", "session_id", "seq", "global_idx", "path", "size", "k", F.when(kind == "session.heartbeat", "doc.save").otherwise(kind).alias("kind"), "content")


@query(
    "c01_file_states",
    f"""{EDITS}, e as (select *, sum(case when kind in ('doc.open', 'fs.external_change') and content is not null then 1 else 0 end) over w as epoch,
      sum(case when kind = 'doc.open' and content is not null then 1 else 0 end) over w as opened from c0 window w as (partition by submission_id, path order by global_idx)),
    l as (select submission_id, path, max(epoch) as epoch, max(opened) as opened, count(*) filter (kind = 'paste' and content is null or kind = 'fs.external_change') as reasons, count(*) filter (kind = 'doc.save') as saves from e group by 1, 2)
    select l.submission_id, l.path, coalesce(string_agg(e.content, '' order by e.global_idx) filter (e.epoch = l.epoch), '') as content,
      sha256(coalesce(string_agg(e.content, '' order by e.global_idx) filter (e.epoch = l.epoch), '')) as sha256,
      count(*) filter (e.opened = l.opened and e.content is null and e.kind in ('paste', 'fs.external_change')) > 0 as tainted, l.reasons, l.saves
    from l join e using (submission_id, path) group by l.submission_id, l.path, l.reasons, l.saves""",
)
def c01_states(t):
    s = versions.file_states(edits(t))
    return s.select("submission_id", "path", "content", "sha256", "tainted", F.size("reasons").cast("long").alias("reasons"), F.size("saves").cast("long").alias("saves"))


@query(
    "c01_save_hashes",
    f"""{EDITS}, e as (select *, sum(case when kind in ('doc.open', 'fs.external_change') and content is not null then 1 else 0 end) over (partition by submission_id, path order by global_idx) as epoch from c0),
    s as (select *, coalesce(string_agg(content, '') over (partition by submission_id, path, epoch order by global_idx rows between unbounded preceding and current row), '') as state from e)
    select submission_id, path, session_id, seq, sha256(state) as replayed from s where kind = 'doc.save'""",
)
def c01_saves(t):
    s = versions.file_states(edits(t)).select("submission_id", "path", F.explode("saves").alias("s"))
    return s.select("submission_id", "path", "s.session_id", "s.seq", "s.replayed")


@query(
    "c04_changes_at_cuts",
    f"""{EDITS}, e as (select *, sum(case when kind in ('doc.open', 'fs.external_change') and content is not null then 1 else 0 end) over (partition by submission_id, path order by global_idx) as epoch from c0),
    s as (select *, coalesce(sum(length(content)) over (partition by submission_id, path, epoch order by global_idx rows between unbounded preceding and current row), 0)::bigint as len from e),
    b as (select *, coalesce(lag(len) over w, 0) as length, coalesce(lag(epoch) over w, 0) as before from s window w as (partition by submission_id, path order by global_idx)),
    q as (select * from b where kind = 'doc.save'),
    d as (select *, lag(length) over w as last_length, lag(before) over w as last_epoch, lag(global_idx) over w as last_cut from q window w as (partition by submission_id, path order by global_idx))
    select submission_id, path, global_idx as cut, length, case when last_cut is not null and last_epoch = before then last_length else 0 end as prefix,
      length - case when last_cut is not null and last_epoch = before then last_length else 0 end as moved from d""",
)
def c04_changes(t):
    e = edits(t)
    c = versions.changes_at(e, e.where("kind = 'doc.save'").select("submission_id", "path", F.col("global_idx").alias("cut")))
    # Where the first edits append to nothing, all of it is new.
    return c.select("submission_id", "path", "cut", "length", F.least("prefix", F.col("length") - F.length("inserted")).alias("prefix"), F.length("inserted").cast("long").alias("moved"))


@query(
    "c09_line_kinds",
    f"""{EDITS}, e as (select *, sum(case when kind in ('doc.open', 'fs.external_change') and content is not null then 1 else 0 end) over (partition by submission_id, path order by global_idx) as epoch,
      max(case when kind in ('doc.open', 'fs.external_change') and content is not null then global_idx end) over (partition by submission_id, path order by global_idx) as start from c0 where kind <> 'fs.external_change'),
    l as (select submission_id, path, max(epoch) as epoch from e group by 1, 2),
    x as (select e.submission_id, e.path, row_number() over (partition by e.submission_id, e.path order by global_idx) - 1 as line, length(content) as length, global_idx as last_event, kind, length(content) as of_kind from e join l using (submission_id, path, epoch) where content is not null)
    select submission_id, path, line, length::bigint as length, last_event, kind, of_kind::bigint as of_kind from x
    union all select l.submission_id, l.path, coalesce(max(x.line) + 1, 0), 0, null, null, null from l left join x using (submission_id, path) group by 1, 2""",
)
def c09_lines(t):
    e = edits(t).where("kind <> 'fs.external_change'")
    return versions.line_kinds(versions.file_states(e), e.select("submission_id", "global_idx", "kind"))


@query(
    "c10_tainted_files",
    f"""{EDITS}, o as (select *, max(case when kind = 'doc.open' and content is not null then global_idx end) over (partition by submission_id, path) as last_open from c0)
    select submission_id, path, coalesce(sum(length(content)) filter (kind = 'doc.change'), 0)::bigint as typed, coalesce(sum(length(content)) filter (kind = 'paste'), 0)::bigint as pasted,
      count(*) filter (kind = 'doc.save') as saves, count(*) filter (content is null and kind in ('paste', 'fs.external_change') and global_idx > coalesce(last_open, -1)) > 0 as tainted from o group by 1, 2""",
)
def c10_tainted(t):
    from ..operators import contents

    e = edits(t)
    stats = contents.file_stats(e.withColumn("text", F.col("content")).withColumn("diff_size", F.lit(0)))
    return stats.select("submission_id", "path", "typed", "pasted", "saves").join(versions.file_states(e).select("submission_id", "path", "tainted"), ["submission_id", "path"])


SAVED = f"""{EDITS}, e as (select *, sum(case when kind = 'doc.open' and content is not null then 1 else 0 end) over w as epoch,
    sum(case when content is null and kind in ('doc.open', 'paste') or kind = 'fs.external_change' then 1 else 0 end) over w as cleared from c0 window w as (partition by submission_id, session_id, path order by seq)),
s as (select *, coalesce(string_agg(case when kind <> 'fs.external_change' then content end, '') over (partition by submission_id, session_id, path, epoch order by seq rows between unbounded preceding and current row), '') as state from e),
r as (select *, sha256(case when size % 4 = 3 then state || 'x' when size % 4 = 1 then first_value(state) over (partition by submission_id, session_id, path, epoch order by seq) else state end) as recorded from s)"""


def recorded(t):
    own = W.partitionBy("submission_id", "session_id", "path").orderBy("seq")
    e = edits(t).withColumn("epoch", F.sum(((F.col("kind") == "doc.open") & F.col("content").isNotNull()).cast("int")).over(own))
    w = W.partitionBy("submission_id", "session_id", "path", "epoch").orderBy("seq")
    e = e.withColumn("state", F.concat_ws("", F.collect_list(F.when(F.col("kind") != "fs.external_change", F.col("content"))).over(w.rowsBetween(W.unboundedPreceding, 0))))
    text = F.when(F.col("size") % 4 == 3, F.concat("state", F.lit("x"))).when(F.col("size") % 4 == 1, F.first("state").over(w)).otherwise(F.col("state"))
    return e.withColumn("sha256", F.when(F.col("kind") == "doc.save", F.sha2(text, 256))).drop("state", "epoch")


@query(
    "d06_saves_by_replay",
    f"""{SAVED}, f as (select submission_id, path, count(distinct session_id) > 1 as shared from c0 group by 1, 2),
    m as (select r.*, shared, last_value(case when kind = 'doc.open' and content is not null then 0 when content is null and kind in ('doc.open', 'paste') or kind = 'fs.external_change' then 1 end ignore nulls) over w as blind,
      coalesce(bool_or(kind = 'doc.open') over w, false) as seen, coalesce(bool_or(kind = 'doc.open' and content is not null) over (partition by submission_id, session_id, path, cleared order by seq), false) as opened,
      max(case when kind = 'fs.external_change' then seq end) over w as outside, max(case when kind = 'doc.save' then seq end) over (partition by submission_id, session_id, path order by seq rows between unbounded preceding and 1 preceding) as saved
      from r join f using (submission_id, path) window w as (partition by submission_id, session_id, path order by seq)),
    m2 as (select *, max(case when kind = 'doc.save' and outside > coalesce(saved, -1) then seq end) over (partition by submission_id, session_id, path order by seq rows between unbounded preceding and 1 preceding) as external_save,
      max(case when kind = 'doc.open' and content is not null then seq end) over (partition by submission_id, session_id, path order by seq) as last_open from m),
    h as (select *, list(case when opened and kind in ('doc.open', 'doc.change', 'paste') then sha256(state) end) over (partition by submission_id, session_id, path, cleared order by seq) as states from m2),
    g as (select *, list_filter(states, lambda x: x is not null) as known from h where kind = 'doc.save')
    select submission_id, session_id, path, seq, case when outside > coalesce(saved, -1) then 'external' when coalesce(blind, shared::int) = 1 or external_save > coalesce(last_open, -1) then case when shared and not seen then 'unobserved' else 'indeterminate' end
      when sha256(state) = recorded then 'match' when opened and list_contains(known[greatest(1, len(known) - {versions.RECENT - 1}):len(known) - 1], recorded) then 'late' else 'mismatch' end as verdict from g""",
)
def d06_replay(t):
    return versions.save_verdicts(recorded(t))


#: Observations are of a submission's own commits; a session goes on from the one three weeks before.
OBSERVED = f"""with recursive {COMMITS.strip()}, {EVENTS}, g as (select *, case when kind = 'git.event' then size % 400 + 1 end as sha from ev),
own as (select distinct submission_id, node, parent from g join commits on node = sha),
above(submission_id, node, ancestor) as (select * from own union select a.submission_id, a.node, o.parent from above a join own o on o.submission_id = a.submission_id and o.node = a.ancestor),
ends as (select submission_id, session_id, max(seq) + 1 as last from ev group by 1, 2),
obs as (select submission_id, session_id, seq, sha from g where sha is not null),
edges as (
    select a.submission_id, a.session_id as s, a.seq as q, b.session_id as r, b.seq as p from obs a join obs b on a.submission_id = b.submission_id and a.session_id <> b.session_id join above v on v.submission_id = a.submission_id and v.node = b.sha and v.ancestor = a.sha
    union all select submission_id, session_id, -1, session_id, last from ends
    union all select submission_id, session_id, -1, session_id, seq from obs
    union all select o.submission_id, o.session_id, seq, o.session_id, last from obs o join ends using (submission_id, session_id)
    union all select a.submission_id, a.session_id, a.seq, a.session_id, b.seq from obs a join obs b on a.submission_id = b.submission_id and a.session_id = b.session_id and a.seq < b.seq
    union all select a.submission_id, a.session_id, a.last, b.session_id, -1 from ends a join ends b on a.submission_id = b.submission_id and right(a.session_id, 1)::int + 3 = right(b.session_id, 1)::int),
reach(submission_id, s, q, r, p) as (select * from edges union select x.submission_id, x.s, x.q, e.r, e.p from reach x join edges e on e.submission_id = x.submission_id and e.s = x.r and e.q = x.p)"""


def observed(t):
    """Events with the commits they observe, those commits' parents, and links between sessions."""
    e = t.events().withColumn("repository", F.lit(0)).withColumn("sha", F.when(F.col("kind") == "git.event", F.col("size") % 400 + 1))
    commits = e.where("sha is not null").select("submission_id", "repository", "sha").distinct().join(t.commits().withColumnRenamed("node", "sha"), "sha")
    week = F.substring("session_id", -1, 1).cast("int")
    s = e.select("submission_id", "session_id", week.alias("week")).distinct()
    links = s.join(s.select("submission_id", F.col("session_id").alias("prev_session_id"), (F.col("week") + 3).alias("week")), ["submission_id", "week"])
    return e, commits, links


@query(
    "f04_event_order",
    f"""{OBSERVED}, d as (select submission_id, session_id, seq, global_idx, coalesce(last_value(case when sha is not null then seq end ignore nulls) over (partition by submission_id, session_id order by seq rows between unbounded preceding and current row), -1) as entry,
      coalesce(first_value(case when sha is not null then seq end ignore nulls) over (partition by submission_id, session_id order by seq rows between current row and unbounded following), last) as leave from g join ends using (submission_id, session_id)),
    p as (select submission_id, global_idx as a, (global_idx * 5 + 2) % 40 as b from ev where global_idx < 40)
    select p.submission_id, a, b, case when y.session_id is null then 'unknown' when a = b then 'same' when x.session_id = y.session_id then case when x.seq < y.seq then 'before' else 'after' end
      when f.s is not null and k.s is null then 'before' when k.s is not null and f.s is null then 'after' else 'concurrent' end as verdict
    from p join d x on x.submission_id = p.submission_id and x.global_idx = a left join d y on y.submission_id = p.submission_id and y.global_idx = b
      left join (select distinct * from reach) f on f.submission_id = p.submission_id and f.s = x.session_id and f.q = x.leave and f.r = y.session_id and f.p = y.entry
      left join (select distinct * from reach) k on k.submission_id = p.submission_id and k.s = y.session_id and k.q = y.leave and k.r = x.session_id and k.p = x.entry""",
)
def f04_order(t):
    e, commits, links = observed(t)
    pairs = e.where("global_idx < 40").select("submission_id", F.col("global_idx").alias("a"), ((F.col("global_idx") * 5 + 2) % 40).alias("b"))
    return reachability.event_order(pairs, e, reachability.event_clocks(e.where("sha is not null"), commits, links))


@query("c16_segmented_replay")
def c16(t):
    """Five users are a submission; each week of a user is a session."""
    e, _, _ = observed(t)
    five = lambda d: d.withColumn("user", F.col("submission_id")).withColumn("submission_id", F.floor(F.col("submission_id") / 5))
    seen = five(e.where("sha is not null")).withColumn("sha", F.col("sha") % 60 + 1)
    commits = seen.select("submission_id", "repository", "sha").distinct().join(t.commits().withColumnRenamed("node", "sha"), "sha")
    # One user of five is known, in every third submission two are.
    known = F.when((F.col("user") % 5 == 0) | ((F.col("user") % 5 == 1) & (F.col("submission_id") % 3 == 0)), F.col("user").cast("string"))
    sessions = five(e).select("submission_id", "session_id", known.alias("contributor")).distinct()
    week = F.substring("session_id", -1, 1).cast("int")
    mine = five(e).select("submission_id", "user", "session_id", week.alias("week")).distinct()
    links = mine.join(mine.select("submission_id", "user", F.col("session_id").alias("prev_session_id"), (F.col("week") + 1).alias("week")), ["submission_id", "user", "week"])
    from ..operators.event_index import global_order

    marks = e.where("sha is not null").select("submission_id", "session_id", "seq", "kind")
    order = global_order(five(t.plain_events())).select("submission_id", "session_id", "seq", "global_idx")
    every = five(edits(t).drop("global_idx")).unionByName(five(marks), allowMissingColumns=True).join(order, ["submission_id", "session_id", "seq"])
    return branches.file_texts(every, sessions, reachability.event_clocks(seen, commits, links))
