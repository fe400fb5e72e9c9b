"""Queries of order across sessions, coverage, and line comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import evidence as op
from ..operators import lineage, moves
from ..sources.adapters import EVENTS
from .registry import query

EV = f"with {EVENTS}"


@query(
    "d11_seal_coverage",
    f"""{EV}, n as (select *, row_number() over (partition by submission_id, session_id order by seq) as nr from ev),
    l as (select submission_id, session_id, count(*) as n, string_agg(kind || chr(10), '' order by seq) as log, string_agg(kind || chr(10), '' order by seq) filter (nr <= 2) as two,
      '{{"checkpoints":[' || string_agg('{{"seq":' || seq::varchar || '}}', ',' order by seq) || '],"v":1}}' as meta from n group by 1, 2),
    s as (select l.*, seal, case seal when 0 then two when 1 then log else 'other' end as text, submission_id % 3 = seal as final from l, range(3) as r(seal))
    select submission_id, session_id, seal, final, case when text = log then 'exact' when seal = 0 and not final then 'partial' else 'no_match' end as log, case when text = log or seal = 0 and not final then strlen(text) end as sealed, strlen(log) as total, false as translated,
      case when seal = 2 then 'unavailable' when seal = 1 or n = 1 then 'exact' when final then 'no_match' else 'partial' end as meta, case when seal = 2 then null when seal = 1 or n = 1 then n when not final then 1 end as meta_sealed, n as meta_total from s""",
)
def d11(t):
    line = lambda x: F.concat(x["kind"], F.lit("\n"))
    g = t.events().groupBy("submission_id", "session_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind"))).alias("rows"))
    meta = lambda rows: F.concat(F.lit('{"checkpoints":['), F.array_join(F.transform(rows, lambda x: F.concat(F.lit('{"seq":'), x["seq"].cast("string"), F.lit("}"))), ","), F.lit('],"v":1}'))
    text = lambda rows: F.array_join(F.transform(rows, line), "")
    logs = g.select("submission_id", "session_id", "rows", text(F.col("rows")).alias("log"), meta(F.col("rows")).alias("meta"))
    s = logs.withColumn("seal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    slog = F.when(F.col("seal") == 0, text(F.slice("rows", 1, 2))).when(F.col("seal") == 1, F.col("log")).otherwise("other")
    digest = F.when(F.col("seal") == 0, F.sha2(meta(F.slice("rows", 1, 1)), 256)).when(F.col("seal") == 1, F.sha2("meta", 256)).otherwise("none")
    seals = s.select("submission_id", "session_id", "seal", F.sha2(slog, 256).alias("slog_sha256"), digest.alias("meta_sha256"), (F.col("submission_id") % 3 == F.col("seal")).alias("final"))
    return op.seal_coverage(seals, logs)


@query("f15_watched_files", f"{EV} select submission_id, path, case when bool_and(k % 10 <> 0) then 'all' when bool_or(k % 10 <> 0) then 'some' else 'none' end as watched from ev group by 1, 2")
def f15(t):
    return op.watched_files(t.events().withColumn("watched", F.col("k") % 10 != 0))


@query("f15_git_gaps", f"{EV} select submission_id, session_id, case when count(*) filter (kind = 'git.event') > 0 then 'observing' when submission_id % 3 = 0 then 'no_repository' when count(*) filter (kind = 'terminal.open') = 0 then 'no_terminal' else 'unknown' end as cause from ev group by 1, 2")
def f15_gaps(t):
    return op.git_gaps(t.events().withColumn("repository", F.col("submission_id") % 3 != 0))


@query("f16_coverage_facts")
def f16(t):
    e = t.events().withColumn("user", F.col("submission_id")).withColumn("submission_id", F.floor(F.col("submission_id") / 5)).withColumn("git_possible", F.lit(True)).withColumn("repository", F.lit(True))
    u = F.col("user")
    ranges = lineage.session_ranges(e).join(e.select("submission_id", "session_id", (u % 3).alias("contributor"), F.when(u % 2 == 0, u % 4).alias("machine")).distinct(), ["submission_id", "session_id"])
    witnesses = e.where("kind = 'paste'").select("submission_id", F.when(F.col("k") % 9 == 0, "short").otherwise("corroborated").alias("verdict"))
    return op.coverage_facts(lineage.capabilities(e), ranges, op.git_gaps(e), witnesses, e.where("k = 7").select("submission_id"))


@query("e06_mass_replacement")
def e06(t):
    w = W.partitionBy("submission_id").orderBy("global_idx")
    p = t.pastes().withColumn("before", F.lag("content").over(w)).where("before is not null")
    return op.mass_replacements(p.select("submission_id", F.col("global_idx").alias("place"), "before", F.col("content").alias("after"), (F.col("global_idx") % 3 != 0).alias("saved")))


@query("e20_internal_moves")
def e20(t):
    """Each conversation writes three files by turns; from the fourth turn on, every third one is a paste of an earlier turn's
    text, and every seventh takes the first lines away."""
    turn = F.col("turn")
    e = t.raw("conversations").select(F.col("conv_id").cast("long").alias("submission_id"), "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    before = F.lag("text", 3).over(W.partitionBy("submission_id").orderBy("turn"))
    e = e.withColumn("moved", F.when((turn >= 3) & (turn % 3 == 0), before))
    gone = turn % 7 == 5
    null = lambda kind, c: F.when(gone, F.lit(c)).cast("int").alias(kind)
    events = e.select(
        "submission_id", F.concat(F.lit("f"), (turn % 2).cast("string")).alias("path"), F.lit("s").alias("session_id"), turn.cast("long").alias("seq"), turn.cast("long").alias("global_idx"),
        F.when(F.col("moved").isNotNull(), "paste").otherwise("doc.change").alias("kind"), F.when(gone, "").otherwise(F.coalesce("moved", "text")).alias("content"),
        null("start_line", 0), null("start_char", 0), null("end_line", 40), null("end_char", 0),
    )
    pastes = events.where("kind = 'paste'").select("submission_id", F.col("global_idx").alias("place"), F.lit(0).alias("ord"), "content")
    return moves.internal_moves(events, pastes)


@query(
    "d18_seal_lint",
    f"""{EV}, s as (select distinct submission_id, session_id from ev), p as (select *, case when submission_id % 7 = 0 then 'missing_manifest' when submission_id % 7 = 1 then 'bad_json' when submission_id % 7 = 2 then 'bad_shape' when submission_id % 7 = 3 then 'id_mismatch' when submission_id % 7 = 4 then 'missing_signature' end as problem from s) select * from p where problem is not null""",
)
def d18_lint(t):
    s = F.col("submission_id") % 7
    named = F.when(s == 3, "other").otherwise(F.col("session_id"))
    text = F.when(s == 1, "{broken").when(s == 2, F.to_json(F.struct("session_id"))).when(s != 0, F.to_json(F.struct(named.alias("session_id"), F.lit("x").alias("slog_sha256"))))
    seals = t.events().select("submission_id", "session_id").distinct().withColumn("manifest", text).withColumn("signature", F.when(s != 4, "sig"))
    return op.seal_problems(seals)
