"""Queries of intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as op
from ..sources.adapters import EVENTS, ROSTER, SUBMISSIONS
from .registry import query

FILES = "files as (select page_id as file_id, page_id % 4 as semester_id, sha256((page_id % 180)::varchar || substr(html, 1, 5)) as blob_sha256, case when page_id % 3 = 0 then 'g' || (page_id % 50)::varchar end as group_key, url as name, page_id from pages)"


def files(t):
    p = F.col("page_id")
    return t.raw("pages").select(p.alias("file_id"), (p % 4).alias("semester_id"), F.sha2(F.concat((p % 180).cast("string"), F.substring("html", 1, 5)), 256).alias("blob_sha256"), F.when(p % 3 == 0, F.concat(F.lit("g"), (p % 50).cast("string"))).alias("group_key"), F.col("url").alias("name"))


@query(
    "j01_new_files",
    f"""with {FILES}, a as (select * from (select *, row_number() over (partition by semester_id, blob_sha256 order by file_id) as n from files) where n = 1),
    b as (select * from (select * exclude n, row_number() over (partition by semester_id, coalesce(group_key, '#' || file_id::varchar) order by file_id) as n from a) where n = 1)
    select file_id, semester_id from b where (semester_id, blob_sha256) not in (select semester_id, blob_sha256 from files where page_id % 10 = 0)""",
)
def j01(t):
    return op.new_files(files(t), files(t).where("file_id % 10 = 0")).select("file_id", "semester_id")


PATTERN = r"example\.org/(?P<assignment_id>[a-z]+)/(?P<sid>[0-9]+)"


@query(
    "j02_matched_students",
    f"""with {FILES}, {ROSTER}, p as (select file_id, nullif(regexp_extract(name, 'example\\.org/([a-z]+)/([0-9]+)', 2), '') as sid, nullif(regexp_extract(name, 'example\\.org/([a-z]+)/([0-9]+)', 1), '') as named from files)
    select file_id, r.id as student_id, coalesce(named, 'm' || (file_id % 3)::varchar) as assignment, case when p.sid is null then 'no_filename_match' when r.id is null then 'unknown_sid' end as reason from p left join roster r on r.sid = p.sid""",
)
def j02(t):
    return op.matched_students(files(t).withColumn("manifest_assignment", F.concat(F.lit("m"), (F.col("file_id") % 3).cast("string"))), t.roster(), PATTERN)


@query("a10_filename_parts", f"with {FILES} select file_id, nullif(regexp_extract(name, 'example\\.org/([a-z]+)/([0-9]+)', 2), '') as sid, nullif(regexp_extract(name, 'example\\.org/([a-z]+)/([0-9]+)', 1), '') as assignment_id from files")
def a10(t):
    parts = op.named_parts(F.col("name"), PATTERN)
    return files(t).select("file_id", *[c.alias(g) for g, c in parts.items()])


@query("j03_versions", f"with {SUBMISSIONS}, v as (select *, row_number() over w as version_index, last_value(id) over (w rows between unbounded preceding and unbounded following) as last from subs window w as (partition by student_id, assignment_id order by ingested_at, id)) select id, student_id, assignment_id, version_index, case when last <> id then last end as superseded_by from v")
def j03(t):
    return op.versions(t.submissions())


@query(
    "j04_group_owners",
    f"""with {SUBMISSIONS}, s as (select id, assignment_id, ingested_at, student_id::varchar as sid from subs), m as (select id, sid from s union all select id, (id % 1500)::varchar from s where id % 4 = 0),
    o as (select id, min(sid) as owner from m group by 1), l as (select sid as owner, assignment_id, max(row(ingested_at, id)) as latest from s group by 1, 2)
    select s.id, s.assignment_id, case when coalesce(row(s.ingested_at, s.id) < latest, false) then s.sid else o.owner end as owner from s join o using (id) left join l on l.owner = o.owner and l.assignment_id = s.assignment_id""",
)
def j04(t):
    s = t.submissions().withColumn("student_sid", F.col("student_id").cast("string"))
    m = s.select("id", F.col("student_sid").alias("sid")).unionAll(s.where("id % 4 = 0").select("id", (F.col("id") % 1500).cast("string").alias("sid")))
    return op.group_owners(m, s)


NEW = "new as (select case when id % 2 = 0 then sid else upper(sid) end as sid, case when id % 10 = 0 then display_name || '!' else display_name end as display_name, case when id % 21 = 0 then 'new@example.org' else email end as email from roster where id % 13 <> 0 union all select 'N' || id::varchar, display_name, null from roster where id % 50 = 0)"


def new_roster(t):
    r, i = t.roster(), F.col("id")
    a = r.where(i % 13 != 0).select(F.when(i % 2 == 0, F.col("sid")).otherwise(F.upper("sid")).alias("sid"), F.when(i % 10 == 0, F.concat("display_name", F.lit("!"))).otherwise(F.col("display_name")).alias("display_name"), F.when(i % 21 == 0, "new@example.org").otherwise(F.col("email")).alias("email"))
    return a.unionAll(r.where(i % 50 == 0).select(F.concat(F.lit("N"), i.cast("string")), "display_name", F.lit(None).cast("string")))


@query("j05_roster_diff", f"with {ROSTER}, {NEW}, j as (select coalesce(lower(a.sid), lower(b.sid)) as sid, case when a.sid is null then 'add' when b.sid is null then 'delete' when a.display_name is distinct from b.display_name or a.email is distinct from b.email then 'update' end as change from roster a full join new b on lower(a.sid) = lower(b.sid)) select * from j where change is not null")
def j05(t):
    return op.roster_diff(t.roster(), new_roster(t), ["display_name", "email"])


@query("j06_roster_upsert", f"with {ROSTER}, {NEW} select coalesce(r.sid, n.sid) as sid, coalesce(n.display_name, r.display_name) as display_name, coalesce(n.email, r.email) as email from roster r full join new n on r.sid = n.sid")
def j06(t):
    return op.upserted_roster(t.roster(), new_roster(t))


@query("j07_identity_links", f"with {ROSTER} select id, case when id % 5 = 0 then 'set' when email is not null and id % 2 = 0 then 'i' || id::varchar end as identity_id from roster")
def j07(t):
    r = t.roster().withColumn("identity_id", F.when(F.col("id") % 5 == 0, "set"))
    i = t.roster().where("id % 2 = 0 and email is not null").select(F.upper("email").alias("email"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("identity_id"))
    return op.identity_links(r, i)


@query(
    "j08_ingest_jobs",
    """with f as (select o_custkey as job, case when o_orderkey % 7 = 0 then 'failed' when o_orderkey % 11 = 0 then 'unmatched' when o_orderkey % 23 = 0 then 'pending' else 'matched' end as status, o_custkey % 19 = 0 and o_orderkey % 2 = 0 as cancelled from orders)
    select job, count(*) as n, count(*) filter (status = 'matched') as n_matched, count(*) filter (status in ('failed', 'unmatched')) as n_bad, count(*) filter (status = 'pending') as n_pending,
      case when bool_or(cancelled) then 'cancelled' when count(*) filter (status = 'pending') > 0 then 'running' when count(*) filter (status in ('failed', 'unmatched')) > 0 then 'partial' else 'succeeded' end as state from f group by 1""",
)
def j08(t):
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "failed").when(k % 11 == 0, "unmatched").when(k % 23 == 0, "pending").otherwise("matched")
    return op.ingest_jobs(t.raw("orders").select(F.col("o_custkey").alias("job"), status.alias("status"), ((F.col("o_custkey") % 19 == 0) & (k % 2 == 0)).alias("cancelled")))


@query("j09_failure_causes", f"with {EVENTS} select kind as phase, (k % 6)::varchar as cause, count(*) as n from ev where size % 4 = 0 group by 1, 2")
def j09(t):
    e = t.events().withColumn("error", F.when(F.col("size") % 4 == 0, F.to_json(F.struct(F.col("kind").alias("phase"), (F.col("k") % 6).alias("cause")))))
    return op.failure_causes(e)


@query("j10_phase_profile", f"with {EVENTS}, g as (select kind as phase, sum(size)::bigint as total, count(*) as n, max(size) as largest from ev group by 1) select *, round(total / sum(total) over (), 6) as share from g")
def j10(t):
    return op.phase_profile(t.events().select(F.col("kind").alias("phase"), F.col("size").alias("ms")))


@query("j11_retention", "select o_orderkey as id, c_nationkey as semester_id from orders join customer on c_custkey = o_custkey where date '1995-01-01' + (c_nationkey * 100)::int < date '1997-06-01'")
def j11(t):
    s = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("semester_id"))
    sem = t.raw("nation").select(F.col("n_nationkey").alias("semester_id"), F.lit("1995-01-01").alias("archived_at"), (F.col("n_nationkey") * 100).cast("int").alias("retention_days"))
    return op.expired(s, sem, "1997-06-01")


@query("j12_storage", "with g as (select page_id % 20 as owner, sum(strlen(html))::bigint as bytes from pages group by 1) select owner, bytes, case when bytes / 60000 >= 0.95 then 'critical' when bytes / 60000 >= 0.8 then 'warn' else 'ok' end as level from g")
def j12(t):
    return op.usage(t.raw("pages").select((F.col("page_id") % 20).alias("owner"), F.octet_length("html").cast("long").alias("bytes")), 60000)


@query("j13_same_artifacts", "with a as (select page_id // 5 as artifact, 'e' || (page_id % 5)::varchar as name, sha256(html) as x from pages), b as (select page_id // 5 as artifact, 'e' || (page_id % 5)::varchar as name, case when page_id % 17 = 0 then 'no' else sha256(html) end as y from pages where page_id % 29 <> 0) select artifact, bool_and(coalesce(x = y, false)) as same from a full join b using (artifact, name) group by 1")
def j13(t):
    p = F.col("page_id")
    a = t.raw("pages").select(F.floor(p / 5).alias("artifact"), F.concat(F.lit("e"), (p % 5).cast("string")).alias("name"), F.sha2("html", 256).alias("sha256"), "page_id")
    return op.same_artifacts(a, a.where("page_id % 29 <> 0").withColumn("sha256", F.when(p % 17 == 0, "no").otherwise(F.col("sha256"))))


@query(
    "j14_scope_selection",
    """with s as (select o_custkey as submission_id, case o_orderkey % 4 when 0 then '' when 1 then 'hw/a' when 2 then 'hw/b/c' else 'x' end as prefix, o_custkey % 4 as assignment_id, o_orderkey % 9 <> 0 as has_manifest, o_orderkey % 2 as declared, o_orderkey from orders),
    n as (select *, count(*) over (partition by submission_id) as n from s), r as (select *, case when not has_manifest then 'no_manifest' when assignment_id = 1 and (n <> 1 or prefix <> '') then 'submission_type_mismatch' when assignment_id = 2 and prefix <> '' then 'scope_excluded' when assignment_id = 3 and not regexp_matches(prefix, '^hw/[^/]*$') then 'scope_excluded' end as r0 from n),
    q as (select *, count(*) filter (r0 is null) over (partition by submission_id, declared) as c from r)
    select submission_id, prefix, r0 is null and not (c > 1 and assignment_id % 2 = 0) as accepted, case when r0 is null and c > 1 and assignment_id % 2 = 0 then 'ambiguous_scope' else r0 end as reason from q""",
)
def j14(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    prefix = F.when(k % 4 == 0, "").when(k % 4 == 1, "hw/a").when(k % 4 == 2, "hw/b/c").otherwise("x")
    s = t.raw("orders").select(c.alias("submission_id"), prefix.alias("prefix"), (c % 4).alias("assignment_id"), (k % 9 != 0).alias("has_manifest"), (k % 2).alias("declared"))
    a = s.select("assignment_id").distinct()
    mode = F.when(F.col("assignment_id") == 0, "self_identifying").when(F.col("assignment_id") == 1, "bundle").when(F.col("assignment_id") == 2, "whole_repo").otherwise("scoped")
    a = a.select("assignment_id", mode.alias("mode"), F.lit("hw/*").alias("path_glob"), F.when(F.col("assignment_id") % 2 == 0, "error").otherwise("all").alias("on_multiple"))
    return op.selected_scopes(s, a)


@query("j15_one_submitter", "select (o_custkey % 300)::varchar as sid, arg_min('n' || o_orderkey::varchar, o_orderkey) filter (o_orderkey % 3 <> 0) as display_name, arg_min('m' || o_orderkey::varchar, o_orderkey) filter (o_orderkey % 5 = 0) as email from orders group by 1")
def j15(t):
    k = F.col("o_orderkey")
    r = t.raw("orders").select((F.col("o_custkey") % 300).cast("string").alias("sid"), k.alias("position"), F.when(k % 3 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("display_name"), F.when(k % 5 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("email"))
    return op.one_submitter_per_sid(r)


@query("j16_limits", "with b as (select page_id % 15 as batch, page_id as position, strlen(html)::bigint as bytes from pages), o as (select *, sum(bytes) over (partition by batch order by position)::bigint as running, count(*) over (partition by batch) as files from b where bytes <= 5000) select batch, position, bytes, running from o where files <= 16")
def j16(t):
    b = t.raw("pages").select((F.col("page_id") % 15).alias("batch"), F.col("page_id").alias("position"), F.octet_length("html").cast("long").alias("bytes"))
    return op.within_limits(b, 5000, 16)
