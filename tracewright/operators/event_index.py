"""Order of events, and questions about a point or a stretch of it. Every window is partitioned by submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Kinds that name a file; limits of the collapsed gap between sessions; split of a contributor's runs.
FILE_KINDS = ("doc.open", "doc.change", "doc.save", "doc.close", "paste", "selection.change", "fs.external_change")
SEAM_MS = (1_000, 5_000)
IDLE_MS = 120_000
PAGE = 2_000


def ordered(*keys: str) -> W:
    return W.partitionBy("submission_id", *keys).orderBy("global_idx")


def global_order(events: DataFrame) -> DataFrame:
    """global_idx from 0 in order of wall (as text), session, seq."""
    return events.withColumn("global_idx", (F.row_number().over(W.partitionBy("submission_id").orderBy("wall", "session_id", "seq")) - 1).cast("long"))


def one_log_per_session(claims: DataFrame) -> DataFrame:
    """Of the logs that claim a session, the one with the smallest digest."""
    return claims.groupBy("submission_id", "session_id").agg(F.min("slog_sha256").alias("slog_sha256"))


def event_file() -> Column:
    return F.when(F.col("kind").isin(*FILE_KINDS), F.col("path"))


def path_aliases(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """submission_id, alias, path: a/b/x stands for the manifest's x if x was seen, but never in a session with a/b/x."""
    own = seen.select("submission_id", "session_id", "path").distinct()
    paths = own.groupBy("submission_id", "path").agg(F.collect_set("session_id").alias("sessions"))
    canon = manifest.select("submission_id", "path").distinct().join(paths, ["submission_id", "path"]).select("submission_id", F.col("path").alias("canon"), F.col("sessions").alias("canon_sessions"))
    last = F.substring_index("path", "/", -1)
    pairs = paths.withColumn("last", last).join(canon.withColumn("last", F.substring_index("canon", "/", -1)), ["submission_id", "last"])
    pairs = pairs.where(F.endswith("path", F.concat(F.lit("/"), "canon")) & ~F.arrays_overlap("sessions", "canon_sessions"))
    return pairs.groupBy("submission_id", F.col("path").alias("alias")).agg(F.min("canon").alias("path"))


def _range(name: str, low: int | None, high: int | None) -> None:
    if any(x is not None and x < 0 for x in (low, high)) or (low is not None and high is not None and low > high):
        raise ValueError(f"{name}: {low} to {high} is no range")


def matching_events(
    events: DataFrame, kinds: list[str] | None = None, seq: tuple[int | None, int | None] = (None, None), t: tuple[int | None, int | None] = (None, None),
    ms: tuple[int | None, int | None] = (None, None), path: str | None = None, session_id: str | None = None,
) -> DataFrame:
    """Events of the kinds, of the ranges of seq, t and wall time (inclusive; None leaves an end open), of a file and a session.
    No kinds means all. A negative or reversed range is an error."""
    for column, (low, high) in (("seq", seq), ("t", t), ("ms", ms)):
        _range(column, low, high)
        if low is not None:
            events = events.where(F.col(column) >= low)
        if high is not None:
            events = events.where(F.col(column) <= high)
    if kinds:
        events = events.where(F.col("kind").isin(kinds))
    if path is not None:
        events = events.where(F.col("path") == path)
    return events if session_id is None else events.where(F.col("session_id") == session_id)


def event_page(events: DataFrame, after: tuple[int, int] | None = None, descending: bool = False, limit: int = PAGE) -> DataFrame:
    """A page of events by (submission_id, global_idx) after a key, at most PAGE rows. A top-k, never a full sort."""
    if limit > PAGE:
        raise ValueError(f"at most {PAGE} events at once")
    if after is not None:
        own, place = F.col("submission_id"), F.col("global_idx")
        beyond = (own < after[0]) | ((own == after[0]) & (place < after[1])) if descending else (own > after[0]) | ((own == after[0]) & (place > after[1]))
        events = events.where(beyond)
    order = (F.desc, F.desc) if descending else (F.asc, F.asc)
    return events.orderBy(order[0]("submission_id"), order[1]("global_idx")).limit(limit)


def event_totals(events: DataFrame) -> DataFrame:
    """(submission_id, total) of matching events, whatever page is looked at."""
    return events.groupBy("submission_id").agg(F.count(F.lit(1)).alias("total"))


def timeline(events: DataFrame, kinds: set[str], files: set[str], sessions: set[str], t: tuple[int, int] | None) -> DataFrame:
    """Events of the given sets; an empty set asks for nothing."""
    for column, wanted in (("kind", kinds), ("path", files), ("session_id", sessions)):
        if wanted:
            events = events.where(F.col(column).isin(*wanted))
    return events.where(F.col("t").between(*t)) if t else events


def at_cursors(rows: DataFrame, asked: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """For each row of ``asked`` (keys, at) the values of the latest of ``rows`` (keys, at, values) at or before it, null
    without one. Both go through one window; no place is joined with another."""
    own = rows.select(*keys, "at", F.struct("at", *values).alias("v"))
    both = own.unionAll(asked.select(*keys, "at", F.lit(None).cast(own.schema["v"].dataType).alias("v")))
    last = F.max("v").over(W.partitionBy(*keys).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("last", last).where("v is null").select(*keys, "at", *[F.col(f"last.{c}").alias(c) for c in values])


def seek(events: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (submission_id, target): the last event at or before it, outcome and distance in ms."""
    rows = events.select("submission_id", F.col("ms").alias("at"), "ms", "global_idx")
    found = at_cursors(rows.withColumn("global_idx", F.max("global_idx").over(W.partitionBy("submission_id").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))), targets.select("submission_id", F.col("target").alias("at")), ["submission_id"], "ms", "global_idx")
    ends = events.groupBy("submission_id").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    e = found.join(ends, "submission_id").withColumnRenamed("at", "target")
    outcome = F.when(F.col("global_idx").isNull(), "before_start").when(F.col("target") > F.col("last"), "after_end").otherwise("inside")
    return e.select("submission_id", "target", F.coalesce("global_idx", F.lit(0)).alias("global_idx"), outcome.alias("outcome"), F.abs(F.col("target") - F.coalesce("ms", "first")).alias("gap_ms"))


def clock(events: DataFrame) -> DataFrame:
    """collapsed: running ms; steps inside a session as they are, but never back, steps between sessions within SEAM_MS."""
    w = ordered()
    inside = F.lag("session_id").over(w) == F.col("session_id")
    step = F.when(F.lag("ms").over(w).isNull(), F.lit(0)).when(inside, F.greatest(F.lit(0), F.col("t") - F.lag("t").over(w))).otherwise(F.least(F.greatest(F.col("ms") - F.lag("ms").over(w), F.lit(SEAM_MS[0])), F.lit(SEAM_MS[1])))
    e = events.withColumn("step", F.coalesce(step, F.lit(0)))
    return e.withColumn("collapsed", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))


def seams(events: DataFrame) -> DataFrame:
    """Events at which the session changes, with the real and the collapsed gap."""
    w = ordered()
    e = clock(events).withColumn("before", F.lag("session_id").over(w)).withColumn("gap_ms", F.col("ms") - F.lag("ms").over(w))
    return e.where("before <> session_id").select("submission_id", "global_idx", F.col("before").alias("from_session"), F.col("session_id").alias("to_session"), "gap_ms", F.col("step").alias("collapsed_ms"))


def flagged_seams(seam_rows: DataFrame, flag_events: DataFrame) -> DataFrame:
    """Seams with a flag (submission_id, session_id, global_idx) in the session they lead to, at or after them."""
    f = flag_events.select("submission_id", F.col("session_id").alias("to_session"), F.col("global_idx").alias("flag_idx"))
    return seam_rows.join(f, ["submission_id", "to_session"]).where("flag_idx >= global_idx").select("submission_id", "global_idx", "to_session").distinct()


def jump_marks(events: DataFrame, flagged: DataFrame) -> DataFrame:
    """What a player can jump to, as 0/1 columns; flagged: (submission_id, global_idx) of events that flags refer to."""
    w = ordered()
    events = events.join(flagged.select("submission_id", "global_idx", F.lit(1).alias("flag")).distinct(), ["submission_id", "global_idx"], "left")
    file = F.last(event_file(), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return events.select(
        "submission_id", "global_idx",
        (F.col("kind") == "paste").cast("int").alias("paste"),
        (F.col("kind") == "fs.external_change").cast("int").alias("external"),
        F.coalesce((event_file() != file).cast("int"), F.lit(0)).alias("file_switch"),
        F.coalesce((F.lag("session_id").over(w) != F.col("session_id")).cast("int"), F.lit(0)).alias("seam"),
        F.coalesce("flag", F.lit(0)).alias("flagged"),
    )


MARKS = ("paste", "external", "file_switch", "seam", "flagged")


def next_marks(events: DataFrame, flagged: DataFrame) -> DataFrame:
    """For every event as a cursor, the next place of each mark after it."""
    after = ordered().rowsBetween(1, W.unboundedFollowing)
    return jump_marks(events, flagged).select("submission_id", "global_idx", *[F.first(F.when(F.col(m) == 1, F.col("global_idx")), True).over(after).alias(f"next_{m}") for m in MARKS])


def remaining_marks(events: DataFrame, flagged: DataFrame) -> DataFrame:
    after = ordered().rowsBetween(1, W.unboundedFollowing)
    return jump_marks(events, flagged).select("submission_id", "global_idx", *[F.coalesce(F.sum(m).over(after), F.lit(0)).cast("long").alias(f"left_{m}") for m in MARKS])


def file_recency(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each (submission_id, cursor) and file touched up to it: age in the cursor's session, or sessions ago."""
    first = events.groupBy("submission_id", "session_id").agg(F.min("global_idx").alias("starts"))
    rank = first.withColumn("nth", F.dense_rank().over(W.partitionBy("submission_id").orderBy("starts"))).select("submission_id", "session_id", "nth")
    e = events.join(rank, ["submission_id", "session_id"]).withColumn("at", F.col("global_idx"))
    asked = cursors.select("submission_id", F.col("cursor").alias("at")).distinct()
    here = at_cursors(e, asked, ["submission_id"], "nth", "ms").select("submission_id", "at", F.col("nth").alias("now_nth"), F.col("ms").alias("now_ms"))
    touched = e.where(event_file().isNotNull())
    each = asked.join(touched.select("submission_id", "path").distinct(), "submission_id")
    files = at_cursors(touched, each, ["submission_id", "path"], "nth", "ms").where("nth is not null")
    j = files.join(here, ["submission_id", "at"])
    return j.select("submission_id", F.col("at").alias("cursor"), "path", F.when(F.col("nth") == F.col("now_nth"), F.col("now_ms") - F.col("ms")).alias("age_ms"), (F.col("now_nth") - F.col("nth")).cast("long").alias("sessions_ago"))


def active_file_changes(events: DataFrame) -> DataFrame:
    """Events at which a contributor's edited file changes."""
    e = events.withColumn("file", event_file()).where("file is not null")
    before = F.lag("file").over(W.partitionBy("submission_id", "contributor").orderBy("global_idx"))
    return e.withColumn("before", before).where("before is null or before <> file").select("submission_id", "contributor", "global_idx", "file")


def active_file_at(changes: DataFrame, cursors: DataFrame) -> DataFrame:
    """The active file of each contributor at (submission_id, cursor)."""
    asked = cursors.select("submission_id", F.col("cursor").alias("at")).distinct().join(changes.select("submission_id", "contributor").distinct(), "submission_id")
    found = at_cursors(changes.withColumn("at", F.col("global_idx")), asked, ["submission_id", "contributor"], "file")
    return found.where("file is not null").select("submission_id", F.col("at").alias("cursor"), "contributor", "file")


def current_external_change(events: DataFrame) -> DataFrame:
    """Each file's last external change, unless a caret event of the file came later."""
    e = events.where(F.col("kind").isin("fs.external_change", "doc.change", "selection.change"))
    last = e.groupBy("submission_id", "path").agg(F.max_by("kind", "global_idx").alias("kind"), F.max("global_idx").alias("global_idx"))
    return last.where("kind = 'fs.external_change'").select("submission_id", "path", "global_idx")


def activity_runs(events: DataFrame) -> DataFrame:
    """Runs of one contributor, split where more than IDLE_MS passes: start, stop, events, and the time before; and the idle
    runs between them (no contributor, no events), under the number of the run that ends them."""
    w = ordered()
    new = (F.lag("contributor").over(w).isNull()) | (F.lag("contributor").over(w) != F.col("contributor")) | (F.col("ms") - F.lag("ms").over(w) > IDLE_MS)
    e = events.withColumn("gap", F.col("ms") - F.lag("ms").over(w)).withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = e.groupBy("submission_id", F.col("run").cast("long").alias("run")).agg(
        F.min("contributor").alias("contributor"), F.min("ms").alias("start_ms"), F.max("ms").alias("stop_ms"), F.count(F.lit(1)).alias("events"), F.coalesce(F.min_by("gap", "global_idx"), F.lit(0)).alias("gap_before_ms"), F.min_by("ms", "global_idx").alias("first_ms"),
    )
    none = F.lit(None).cast(runs.schema["contributor"].dataType)
    own = F.struct(F.lit(False).alias("idle"), F.col("contributor"), F.col("start_ms"), F.col("stop_ms"), F.col("events"), F.col("gap_before_ms"))
    idle = F.struct(F.lit(True).alias("idle"), none.alias("contributor"), (F.col("first_ms") - F.col("gap_before_ms")).alias("start_ms"), F.col("first_ms").alias("stop_ms"), F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("gap_before_ms"))
    return runs.select("submission_id", "run", F.explode(F.when(F.col("gap_before_ms") > IDLE_MS, F.array(own, idle)).otherwise(F.array(own))).alias("r")).select("submission_id", "run", "r.*")


def overlaps(envelopes: DataFrame) -> DataFrame:
    """Stretches in which at least two of a submission's envelopes (contributor, start_ms, stop_ms) are open.

    A sweep: endpoints are counted in order, so no envelope is compared with another.
    """
    ends = envelopes.select("submission_id", F.col("start_ms").alias("at"), F.lit(1).alias("d")).unionAll(envelopes.select("submission_id", F.col("stop_ms").alias("at"), F.lit(-1).alias("d")))
    points = ends.groupBy("submission_id", "at").agg(F.sum("d").alias("d"))
    w = W.partitionBy("submission_id").orderBy("at")
    s = points.withColumn("active", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("until", F.lead("at").over(w))
    return s.where("active >= 2 and until > at").select("submission_id", F.col("at").alias("start_ms"), F.col("until").alias("stop_ms"), F.col("active").cast("long").alias("active"))


def focus_away(events: DataFrame) -> DataFrame:
    """For every event: whether the latest focus event so far was a loss, with its reason (gained, reason columns)."""
    seen = ordered().rowsBetween(W.unboundedPreceding, 0)
    is_focus = F.col("kind") == "focus.change"
    last = F.last(F.when(is_focus, F.struct("gained", "reason")), True).over(seen)
    return events.select("submission_id", "global_idx", F.coalesce(~last["gained"], F.lit(False)).alias("away"), F.when(~last["gained"], last["reason"]).alias("reason"))


def extension_inventory(seen: DataFrame, built_in: list[str], ai_tokens: list[str]) -> DataFrame:
    """Latest version of every extension of a submission but the built-in ones; those with an AI token first."""
    e = seen.where(~F.col("extension").isin(*built_in)).groupBy("submission_id", "extension").agg(F.max_by("version", "global_idx").alias("version"))
    ai = F.arrays_overlap(F.split(F.lower("extension"), "[._-]"), F.array(*map(F.lit, ai_tokens)))
    e = e.withColumn("ai", ai)
    return e.withColumn("place", F.row_number().over(W.partitionBy("submission_id").orderBy(F.desc("ai"), "extension")).cast("long"))


def session_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("submission_id", "session_id").agg(F.min_by("wall", "seq").alias("first_wall"), F.count(F.lit(1)).alias("events"))


def order_breaks(ranked: DataFrame) -> DataFrame:
    """Neighbours in presentation order (submission_id, place, node, verdict with the one before) that aren't ordered."""
    return ranked.where(F.col("verdict").isin("concurrent", "unknown", "unordered"))


def cursor_position(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """The latest selection of each file at (submission_id, cursor)."""
    e = events.where("kind = 'selection.change'").withColumn("at", F.col("global_idx"))
    asked = cursors.select("submission_id", F.col("cursor").alias("at")).distinct().join(e.select("submission_id", "path").distinct(), "submission_id")
    found = at_cursors(e.withColumn("held", F.struct("range")), asked, ["submission_id", "path"], "held")
    return found.where("held is not null").select("submission_id", F.col("at").alias("cursor"), "path", "held.range")


def lanes(active: DataFrame, n: int, verdicts: DataFrame | None = None) -> DataFrame:
    """Contributors at a cursor by active file: idle, single, or several of them (converged unless verdicts say other)."""
    g = active.groupBy("submission_id", "cursor", "file").agg(F.count(F.lit(1)).alias("contributors"), F.min("contributor").alias("first"))
    kind = F.when(F.col("file").isNull(), "idle").when(F.col("contributors") == 1, "single")
    if verdicts is not None:
        g = g.join(verdicts, ["submission_id", "file"], "left")
        kind = kind.otherwise(F.coalesce("verdict", F.lit("unknown")))
    else:
        kind = kind.otherwise("converged")
    place = F.row_number().over(W.partitionBy("submission_id", "cursor").orderBy(F.desc("contributors"), F.asc_nulls_last("file")))
    return g.select("submission_id", "cursor", "file", F.col("contributors").cast("long"), kind.alias("state"), (place <= n).alias("lane"))
