"""Queries over the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as op
from ..operators import scoring
from ..sources.adapters import EVENTS, FLAGS, ROSTER, SUBMISSIONS
from .registry import query
from .scoring_queries import COUNTS, NAME, RANK, SCORED, scored

ROWS = f"""{SCORED}, {ROSTER}, g as (select submission_id as id, sum(flag_score) as s, max(rk) as m from scored group by 1),
rows as (select s.*, round(coalesce(g.s, 0), 6) as score_total, {NAME.format("m")} as score_max_severity, r.display_name from subs s left join g using (id) left join roster r on r.id = s.student_id)"""


def rows(t):
    s = scoring.submission_scores(t.submissions(), scored(t))
    return s.join(t.roster().select(F.col("id").alias("student_id"), "display_name"), "student_id", "left")


def high(t):
    return t.flags().where("severity = 'high' and confidence >= 0.5")


def chosen(t):
    return op.filtered(rows(t), validation_status=["fail", "warn"], assignment_id=[1, 2, 3, 4, 5], flags=high(t), without=t.flags().where("heuristic_id = 'h3'"), search="er#0", score=(5.0, 60.0), active_min=(10, 200))


CHOSEN = f"""{ROWS}, chosen as (select * from rows where validation_status in ('fail', 'warn') and assignment_id in (1, 2, 3, 4, 5) and display_name ilike '%er#0%'
  and score_total between 5 and 60 and active_min between 10 and 200 and id in (select submission_id from flags where severity = 'high' and confidence >= 0.5)
  and id not in (select submission_id from flags where heuristic_id = 'h3'))"""


@query("i01_submission_list", f"{CHOSEN} select id, student_id, score_total, validation_status from chosen")
def i01(t):
    return chosen(t).select("id", "student_id", "score_total", "validation_status")


@query("i02_page_by_score", f"{ROWS} select id, score_total, ingested_at from rows where score_total < 40 or (score_total = 40 and id > 0) order by score_total desc, id limit 51")
def i02(t):
    return op.page(rows(t), [("score_total", True), ("id", False)], [40.0, 0], 50).select("id", "score_total", "ingested_at")


@query("i02_page_by_time", f"{ROWS} select id, ingested_at from rows where ingested_at > '1996-06-01' or (ingested_at = '1996-06-01' and id > 100) order by ingested_at, id limit 51")
def i02_time(t):
    return op.page(rows(t), [("ingested_at", False), ("id", False)], ["1996-06-01", 100], 50).select("id", "ingested_at")


@query("i03_total", f"{CHOSEN} select count(*) as n from chosen")
def i03(t):
    return chosen(t).agg(F.count(F.lit(1)).alias("n"))


@query(
    "i04_enriched",
    f"{CHOSEN}, a as (select distinct assignment_id, 'A' || assignment_id::varchar as label from subs where assignment_id <> 4) select c.id, label, c.display_name, (select list_sort(list(distinct 'c' || (supp % 3)::varchar)) from flags f where f.submission_id = c.id) as contributors from chosen c join a using (assignment_id)",
)
def i04(t):
    a = t.submissions().where("assignment_id <> 4").select("assignment_id", F.concat(F.lit("A"), F.col("assignment_id").cast("string")).alias("label")).distinct()
    c = t.flags().select("submission_id", F.concat(F.lit("c"), (F.col("supp") % 3).cast("string")).alias("contributor_key"))
    return op.enriched(chosen(t).drop("display_name"), a, t.roster(), c).select("id", "label", "display_name", "contributors")


@query(
    "i05_student_rollup",
    f"""{ROWS}, c as (select * from rows where validation_status = 'fail'), s as (select student_id, count(distinct id) as submissions, round(sum(score_total), 6) as score_sum, max(score_total) as score_max, (max(row(score_total, id)))[2] as worst from c group by 1),
    f as (select student_id, count(*) as flags from subs join flags on submission_id = id group by 1)
    select student_id, submissions, score_sum, score_max, worst, coalesce(flags, 0) as flags from s left join f using (student_id)""",
)
def i05(t):
    r = rows(t)
    return op.student_rollup(t.submissions(), r.where("validation_status = 'fail'"), t.flags())


STUDENTS = f"""{ROWS}, c as (select *, case when id % 11 = 0 then 4 when id % 7 = 0 then 3 when id % 3 = 0 then 2 else 1 end as nr from rows where validation_status = 'fail'),
s as (select c.student_id, count(distinct c.id) as submissions, round(sum(score_total), 6) as score_sum, max(score_total) as score_max, max(nr) as nr from c group by 1),
l as (select student_id, submissions, score_sum, score_max, display_name, ['fresh', 'stale', 'recomputing', 'error'][nr] as recompute_status from s left join roster r on r.id = student_id)"""


def students(t, order, after, limit):
    r = rows(t).where("validation_status = 'fail'")
    i = F.col("id")
    chosen_ = r.withColumn("recompute_status", F.when(i % 11 == 0, "error").when(i % 7 == 0, "recomputing").when(i % 3 == 0, "stale").otherwise("fresh"))
    rollup = op.student_rollup(t.submissions(), r, t.flags()).drop("worst", "flags")
    return op.student_page(rollup, chosen_, t.roster(), order, after, limit)


@query("i05_students_by_sum", f"{STUDENTS} select * from l order by score_sum desc, student_id limit 101")
def i05_sum(t):
    return students(t, "score_sum_desc", None, 100)


@query("i05_students_by_name", f"{STUDENTS} select * from l where display_name > 'Customer#000000040' or (display_name = 'Customer#000000040' and student_id > 40) order by display_name, student_id limit 101")
def i05_name(t):
    return students(t, "student_asc", ["Customer#000000040", 40], 100)


FACETS = {"score_max_severity": ["high", "medium"], "validation_status": ["fail"], "assignment_id": [1, 2, 3]}
_ALL = {"score_max_severity": "score_max_severity in ('high', 'medium')", "validation_status": "validation_status = 'fail'", "assignment_id": "assignment_id in (1, 2, 3)"}


@query("i06_facets", f"{ROWS} " + " union all ".join(f"select '{c}' as facet, {c}::varchar as value, count(*) as n from rows where {' and '.join(v for k, v in _ALL.items() if k != c)} group by {c}" for c in _ALL))
def i06(t):
    return op.facets(rows(t), FACETS)


@query(
    "i07_assignment_stats",
    f"""{ROWS}, a as (select distinct o_orderkey % 14 as assignment_id from orders), kept as (select * from rows where assignment_id <> 5)
    select a.assignment_id, count(id) as n, count(distinct student_id) as students, coalesce(round(avg(score_total), 6), 0) as mean, coalesce(round(quantile_cont(score_total, 0.5), 6), 0) as median,
      coalesce(round(quantile_cont(score_total, 0.95), 6), 0) as p95, count(*) filter (validation_status = 'fail') as fails, count(*) filter (validation_status = 'warn') as warns from a left join kept using (assignment_id) group by 1""",
)
def i07(t):
    a = t.raw("orders").select((F.col("o_orderkey") % 14).alias("assignment_id")).distinct()
    return op.assignment_stats(a, rows(t).where("assignment_id <> 5"))


@query("i08_summary", f"with {SUBMISSIONS}, {FLAGS}, {ROSTER}, c as (select submission_id as id, {COUNTS}, count(distinct part) as files from flags group by 1) select s.id, display_name, " + ", ".join(f"coalesce(n_{x}, 0) as n_{x}" for x in scoring.SEVERITIES) + ", coalesce(files, 0) as files from subs s left join roster r on r.id = s.student_id left join c on c.id = s.id")
def i08(t):
    files = t.flags().select("submission_id", F.col("part").alias("path"))
    return op.summary(t.submissions().select("id", "student_id"), t.roster(), scoring.severity_counts(t.flags(), "submission_id"), files).drop("student_id")


@query("i09_flags_of_submission", f"with {FLAGS} select line, part, heuristic_id, severity, confidence, row_number() over (order by {RANK} desc, confidence desc, line, part) as place from flags where submission_id = 7")
def i09(t):
    from pyspark.sql.window import Window as W

    f = t.flags().where("submission_id = 7")  # one submission's flags are few
    return f.select("line", "part", "heuristic_id", "severity", "confidence", F.row_number().over(W.partitionBy("submission_id").orderBy(F.desc(scoring.rank("severity")), F.desc("confidence"), "line", "part")).cast("long").alias("place"))


@query("i10_supporting_by_session", f"with {EVENTS}, f as (select submission_id::varchar || kind as flag_id, session_id, list(global_idx order by global_idx) as places from ev where kind in ('paste', 'git.event') group by 1, 2) select *, count(*) over (partition by flag_id) as sessions from f")
def i10(t):
    return op.by_session(t.events().where("kind in ('paste', 'git.event')").withColumn("flag_id", F.concat(F.col("submission_id").cast("string"), "kind")))


@query("i11_roster_search", f"with {ROSTER} select id, display_name, email from roster where display_name ilike '%00012%' or email ilike '%12@%' order by id limit 25")
def i11(t):
    r = t.roster()
    return r.where(op.contains(F.col("display_name"), "00012") | op.contains(F.col("email"), "12@")).orderBy("id").limit(25).select("id", "display_name", "email")


@query("i12_audit", "select event_id, user_id as actor, event_type as action, epoch_us(ts) as at_us from events where event_type in ('purchase', 'error') and user_id in (1, 2, 3, 5, 8, 13) and epoch_us(ts) < 1706000000000000 order by at_us desc, event_id desc limit 101")
def i12(t):
    e = t.raw("events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return op.page(e.where("action in ('purchase', 'error') and actor in (1, 2, 3, 5, 8, 13) and at_us < 1706000000000000"), [("at_us", True), ("event_id", True)], None, 100)


@query("i13_unmatched", "select page_id, url from pages where page_id % 3 = 0 and page_id > 30 order by page_id limit 51")
def i13(t):
    return op.page(t.raw("pages").where("page_id % 3 = 0"), [("page_id", False)], [30], 50).select("page_id", "url")


PROTECTED = f"with {ROSTER}, p as (select id, semester_id, case when id % 3 = 0 then id // 3 end as protected_index from roster)"


@query("i14_anonymised", f"{PROTECTED}, l as (select id, coalesce(protected_index::varchar, substr(sha256(id::varchar), 1, 6)) as label from p) select id, 'Student ' || label as display_name, 'S ' || label as sid, null::varchar as email from l")
def i14(t):
    return op.anonymised(t.roster().withColumn("protected_index", F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 3))))


@query("i15_protected_indices", f"{PROTECTED} select id, semester_id, coalesce(protected_index, coalesce(max(protected_index) over (partition by semester_id), 0) + row_number() over (partition by semester_id, protected_index is null order by sha256('s1' || id::varchar))) as protected_index from p")
def i15(t):
    return op.protected_indices(t.roster().withColumn("protected_index", F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 3))), "s1")
