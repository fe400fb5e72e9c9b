"""Queries of the detectors: events are written as files in order of time and read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapters import EVENTS
from ..sources.keyed import names_in
from ..streaming import detectors as op
from .registry import query
from .staging import discard, new_path, staged

EV = f"with {EVENTS}"


FILES = 4
#: Rows of a quarter from which it is written by several tasks, and how many files it has then.
LARGE, SPREAD = 100_000, 8


def fed(t, again=False, **extra):
    """A stream of the events, a micro-batch for each quarter of their time; with ``again`` some come twice."""
    e = t.plain_events().withColumn("wall_ts", F.timestamp_millis("ms"))
    for c, v in extra.items():
        e = e.withColumn(c, v)
    e = e.select(*[c.split()[0] for c in op.EVENT.split(", ")]).withColumn("k", F.col("k").cast("int")).withColumn("sent", F.col("ms"))
    if again:
        e = e.unionAll(e.where("k % 10 = 0").withColumn("sent", F.col("sent") + 300_000))
    e = staged(e, "events")
    first, last = e.agg(F.min("sent"), F.max("sent")).head()
    quarter = F.least(F.floor((F.col("sent") - F.lit(first)) * FILES / F.lit(max(1, (last or 0) - (first or 0)))), F.lit(FILES - 1))
    sizes = {r["q"]: r["count"] for r in e.groupBy(quarter.alias("q")).count().collect()}
    files = SPREAD if min(sizes.get(i, 0) for i in range(FILES)) >= LARGE else 1
    folder = new_path(t.spark, "stream")
    for i in range(FILES):  # one after another: a stream takes files by age
        part = e.where(quarter == i).drop("sent")
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.sortWithinPartitions("wall_ts").write.mode("append").parquet(folder)
        if len([n for n in names_in(t.spark, folder) if n.endswith(".parquet")]) != files * (i + 1):
            raise RuntimeError("a quarter of the events has another number of files than a micro-batch takes")
    discard(e)
    return op.event_stream(t.spark, folder, files)


def drained(t, stream, mode="append"):
    return op.drained(stream, new_path(t.spark, "drained"), "q", mode)


def detected(t, stream, processor, schema, *keys):
    return op.detected(stream, processor, schema, *keys, checkpoint=new_path(t.spark, "detected"))


@query("k01_deduplicated_stream", f"{EV} select session_id, seq, kind from ev")
def k01(t):
    return drained(t, fed(t, again=True).select("session_id", "seq", "kind"))


@query(
    "k02_paste_mismatch",
    f"{EV}, w as (select session_id, time_bucket(interval '4 hours', make_timestamp(ms * 1000), timestamp '1970-01-01') as start, count(*) filter (kind = 'paste') as pastes, count(*) filter (kind = 'doc.change' and size > 100) as inserts from ev group by 1, 2) select session_id, epoch_us(start) as start_us, pastes, inserts from w where abs(pastes - inserts) > 1",
)
def k02(t):
    s = fed(t).withColumn("large_insert", (F.col("kind") == "doc.change") & (F.col("size") > 100))
    out = drained(t, op.paste_mismatches(s, 4 * 3600), "complete")
    return out.select("session_id", F.unix_micros("start").alias("start_us"), "pastes", "inserts")


@query("k03_paste_like", f"{EV} select session_id, seq from ev where kind = 'doc.change' and (size >= 60 or (size // 2 + 5 >= 30 and k % 2 = 0))")
def k03(t):
    s = fed(t).where("kind = 'doc.change'")
    a = F.repeat(F.lit("x"), F.floor(F.col("size") / 2).cast("int"))
    deltas = F.array(a, F.when(F.col("k") % 2 == 0, F.lit("y\nyyy")).otherwise(F.lit("yyyyy")))
    return drained(t, s.where(op.is_paste_like(deltas)).select("session_id", "seq"))


@query("k04_clock_skew")
def k04(t):
    s = fed(t, ms=F.col("ms") + F.when(F.col("k") % 10 == 0, 700).otherwise(0))
    return detected(t, s, op.ClockSkew(), "session_id string, seq long, delta_ms long", "session_id")


@query("k05_resume_gaps", f"{EV}, h as (select session_id, seq, t - lag(t) over (partition by session_id order by seq) as gap_ms from ev where kind = 'session.heartbeat') select * from h where gap_ms >= 60000")
def k05(t):
    return detected(t, fed(t).where("kind = 'session.heartbeat'"), op.ResumeGap(), "session_id string, seq long, gap_ms long", "session_id")


@query(
    "k06_change_bursts",
    f"""{EV}, c as (select *, case when ms - lag(ms) over w <= 43200000 then 0 else 1 end as new from ev where kind = 'fs.external_change' window w as (partition by session_id, path order by ms)),
    r as (select *, sum(new) over (partition by session_id, path order by ms) as run from c) select session_id, path, min(ms) * 1000 as start_us, count(*) as edits, max(size) as diff from r group by session_id, path, run""",
)
def k06(t):
    out = drained(t, op.change_bursts(fed(t), "12 hours"), "complete")
    return out.select("session_id", "path", F.unix_micros("start").alias("start_us"), "edits", "diff")


@query("k07_explanation_tags")
def k07(t):
    p = op.ExplanationTags()
    p.within_ms = 86_400_000
    return detected(t, fed(t), p, "session_id string, seq long, path string, tag string", "session_id")


@query(
    "k08_external_change",
    f"{EV}, s as (select session_id, path, seq, case when kind = 'session.heartbeat' then 'doc.save' else kind end as kd, k, size, lag(k) over w as lk, lag(size) over w as ls from ev window w as (partition by session_id, path order by seq)) select session_id, path, seq, abs(size - ls) as diff_size from s where kd = 'doc.save' and lk is not null and lk <> k",
)
def k08(t):
    s = fed(t, kind=F.when(F.col("kind") == "session.heartbeat", "doc.save").otherwise(F.col("kind")))
    return detected(t, s, op.ExternalChange(), "session_id string, path string, seq long, diff_size long", "session_id", "path")


@query("k09_chain_continuity", f"{EV}, h as (select session_id, seq, lag(k::varchar) over (partition by session_id order by seq) as expected, (k // 2)::varchar as prev_hash from ev) select session_id, seq, expected from h where expected is not null and expected <> prev_hash")
def k09(t):
    s = fed(t).withColumn("hash", F.col("k").cast("string")).withColumn("prev_hash", F.floor(F.col("k") / 2).cast("string"))
    return detected(t, s, op.ChainContinuity(), "session_id string, seq long, expected string", "session_id")


@query("k10_throttle")
def k10(t):
    p = op.Throttle()
    p.window_ms = 86_400_000
    return detected(t, fed(t), p, "session_id string, seq long, suppressed long", "session_id")


@query("k12_flag_counters", f"{EV}, w as (select *, unnest([0, 1]) as o from ev where kind = 'paste') select (ms // 43200000 - o) * 43200000000 as start_us, submission_id % 12 as assignment_id, case when size > 100 then 'high' else 'low' end as severity, count(*) as n from w group by 1, 2, 3")
def k12(t):
    s = fed(t).where("kind = 'paste'").withColumn("assignment_id", F.col("submission_id") % 12).withColumn("severity", F.when(F.col("size") > 100, "high").otherwise("low"))
    out = drained(t, op.flag_counters(s, "24 hours", "12 hours"), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "assignment_id", "severity", "n")


@query("k13_file_observation")
def k13(t):
    s = fed(t, kind=F.when(F.col("k") % 9 == 0, "gone").otherwise("seen"), k=F.col("k") % 4)
    return detected(t, s, op.FileObservation(), "session_id string, path string, seq long, change string", "session_id", "path")


@query("k11_live_flags", f"{EV} select submission_id, heuristic_id, severity, round(flag_score, 6) as flag_score from (select submission_id, 'h' || (k % 28)::varchar as heuristic_id, case when size > 100 then 'high' else 'low' end as severity, case when size > 100 then 8 else 1 end * 0.5::double * (1 + (k % 28 % 3) * 0.5::double) as flag_score, k from ev where kind = 'paste') where k % 28 % 9 <> 0")
def k11(t):
    s = fed(t).where("kind = 'paste'").select("submission_id", "session_id", "seq", F.concat(F.lit("h"), (F.col("k") % 28).cast("string")).alias("heuristic_id"), F.when(F.col("size") > 100, "high").otherwise("low").alias("severity"), F.lit(0.5).alias("confidence"))
    path = new_path(t.spark, "live")
    config = t.config()
    q = s.writeStream.foreachBatch(lambda df, i: op.write_flags(df, path, config, i)).option("checkpointLocation", new_path(t.spark, "live-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return op.live_flags(t.spark, path).select("submission_id", "heuristic_id", "severity", F.round("flag_score", 6).alias("flag_score"))
