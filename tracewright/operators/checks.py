"""Validation of logs. Checks of one row need no shuffle; checks along a session use one window partitioned by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed value: the previous hash of a session's first line.
GENESIS = "0" * 64
SESSION = ("submission_id", "session_id")
#: The report's checks in order, and fields that only a 2.0 manifest has.
CHECKS = ("chain", "seq", "monotonic_t", "monotonic_wall", "save_hashes", "submitted_code", "session_binding", "log_bytes")
NEW_FIELDS = ("contributors", "rolling", "final", "scope_capped")


def by_seq() -> W:
    return W.partitionBy(*SESSION).orderBy("seq")


def by_position() -> W:
    return W.partitionBy(*SESSION).orderBy("position")


def canonical_of(line: Column) -> Column:
    """The hashed part of a canonical log line: hash and prev_hash taken out where they stand in the key order.

    Keys are sorted (data, hash, kind, prev_hash, seq, t, wall), so hash follows data and prev_hash follows kind; the
    pattern is tied to the line's end, so that data that looks alike isn't touched.
    """
    tail = r'"hash":"[0-9a-f]{64}",("kind":"[^"]*",)"prev_hash":"[0-9a-f]{64}",("seq":[0-9]+,"t":[-0-9.eE+]+,"wall":"[^"]*"\})$'
    return F.regexp_replace(line, tail, "$1$2")


def chain_failures(lines: DataFrame) -> DataFrame:
    """Rows whose hash is not that of their own prev_hash and canonical form."""
    return lines.where(F.sha2(F.concat("prev_hash", "canonical"), 256) != F.col("hash"))


def first_break(lines: DataFrame) -> DataFrame:
    """The first broken row of each session and why: by position, then seq, link, hash, t, wall."""
    w = by_position()
    linked = F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)) == F.col("prev_hash")
    reason = (
        F.when(F.col("seq") != F.col("position"), "seq_gap")
        .when(~linked, "prev_link")
        .when(F.sha2(F.concat("prev_hash", "canonical"), 256) != F.col("hash"), "hash")
        .when(F.col("t") < F.lag("t").over(w), "t")
        .when(F.col("wall") < F.lag("wall").over(w), "wall")
    )
    return lines.withColumn("reason", reason).where("reason is not null").groupBy(*SESSION).agg(F.min("position").alias("position"), F.min_by("reason", "position").alias("reason"))


def seq_gaps(lines: DataFrame) -> DataFrame:
    """The first row of each run of rows whose seq is not their position."""
    off = (F.col("seq") != F.col("position")).cast("int")
    e = lines.withColumn("off", off).withColumn("before", F.coalesce(F.lag("off").over(by_position()), F.lit(0)))
    return e.where("off = 1 and before = 0").select(*SESSION, "position", "seq")


def t_regressions(lines: DataFrame) -> DataFrame:
    e = lines.withColumn("before", F.lag("t").over(by_position()))
    return e.where("t < before").select(*SESSION, "seq", "t", "before")


def wall_regressions(lines: DataFrame) -> DataFrame:
    """Rows whose wall goes back, but for those with a clock.skew event between the row before and the row itself."""
    w = by_position()
    skew = F.last(F.when(F.col("kind") == "clock.skew", F.col("position")), True).over(w.rowsBetween(W.unboundedPreceding, 0))
    e = lines.withColumn("before", F.lag("wall").over(w)).withColumn("skew", skew)
    return e.where("wall < before and (skew is null or skew < position - 1)").select(*SESSION, "seq", "wall", "before")


def save_hashes(states: DataFrame, history: int = 32) -> DataFrame:
    """Saves (kind doc.save with sha256 saved) against the states before them (state: hash of content after each event of
    the file): match, late (one of the last ``history`` states), mismatch, or indeterminate without a known state."""
    w = W.partitionBy(*SESSION, "path").orderBy("seq")
    s = states.withColumn("recent", F.array_compact(F.collect_list("state").over(w.rowsBetween(-history, -1)))).withColumn("now", F.last("state", True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    verdict = F.when(F.col("now").isNull(), "indeterminate").when(F.col("now") == F.col("saved"), "match").when(F.array_contains("recent", F.col("saved")), "late").otherwise("mismatch")
    return s.where("kind = 'doc.save'").select(*SESSION, "path", "seq", verdict.alias("verdict"))


def submitted_verdicts(manifest: DataFrame, observed: DataFrame, broken: DataFrame, concurrent: DataFrame) -> DataFrame:
    """Verdict of each submitted file (role, status, provisional: recorded before the manifest was trusted) against its last
    recorded hash, or against all last states of a file of ``concurrent`` (submission_id, path, states: their hashes)."""
    last = observed.groupBy("submission_id", "path").agg(F.max_by("sha256", "global_idx").alias("recorded"))
    m = manifest.join(last, ["submission_id", "path"], "left").join(broken.select("submission_id", F.lit(True).alias("broken")).distinct(), "submission_id", "left")
    m = m.join(concurrent.select("submission_id", "path", "states"), ["submission_id", "path"], "left")
    verdict = (
        F.when(F.col("role") == "attachment", "attachment")
        .when(F.col("status") == "missing", "missing")
        .when(F.col("provisional"), "unknown_provisional")
        .when(F.col("broken"), "unknown_chain")
        .when(F.col("recorded").isNull(), "unknown_no_record")
        .when(F.col("states").isNotNull(), F.when(F.array_contains("states", F.col("submitted_sha256")), "match_concurrent").otherwise("unknown_concurrent"))
        .when(F.col("recorded") == F.col("submitted_sha256"), "match")
        .otherwise("mismatch")
    )
    return m.select("submission_id", "path", verdict.alias("verdict"))


def concurrent_last_states(last: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose last states (submission_id, path, session_id, contributor) come from sessions that no other follows
    (before: submission_id, a, b: session a is before b) and from at least two contributors."""
    b = before.select("submission_id", F.col("a").alias("session_id"), F.col("b").alias("later"))
    pairs = last.join(b, ["submission_id", "session_id"]).join(last.select("submission_id", "path", F.col("session_id").alias("later")), ["submission_id", "path", "later"])
    open_ = last.join(pairs.select("submission_id", "path", "session_id").distinct(), ["submission_id", "path", "session_id"], "left_anti")
    g = open_.groupBy("submission_id", "path").agg(F.countDistinct("contributor").alias("contributors"), F.count(F.lit(1)).alias("states"))
    return g.where("contributors >= 2")


def session_binding(sessions: DataFrame) -> DataFrame:
    """pass if all sessions of a submission carry one manifest signature."""
    g = sessions.groupBy("submission_id").agg(F.countDistinct("manifest_sig").alias("sigs"), F.count_if(F.col("manifest_sig").isNull()).alias("nulls"))
    return g.select("submission_id", F.when((F.col("sigs") == 1) & (F.col("nulls") == 0), "pass").otherwise("fail").alias("status"))


def log_bytes(sessions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest digest against the archived log's, as it is and with line feeds only."""
    m = manifest.select(*SESSION, F.col("slog_sha256").alias("expected"))
    j = sessions.join(m, list(SESSION), "left")
    plain = F.sha2(F.replace(F.col("log"), F.lit("\r\n"), F.lit("\n")), 256)
    verdict = F.when(F.col("expected").isNull() | ~F.col("expected").rlike("^[0-9a-f]{64}$"), "not_evaluated").when(F.sha2("log", 256) == F.col("expected"), "match").when(plain == F.col("expected"), "match_normalised").otherwise("mismatch")
    return j.select(*SESSION, verdict.alias("verdict"))


def unanimous(verdicts: DataFrame) -> DataFrame:
    """One verdict per session: the common one, or indeterminate."""
    g = verdicts.groupBy(*SESSION).agg(F.min("verdict").alias("a"), F.max("verdict").alias("b"))
    return g.select(*SESSION, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("indeterminate").alias("verdict"))


def checkpoint_agreement(checkpoints: DataFrame, lines: DataFrame) -> DataFrame:
    """Checkpoints (seq, hash, sig_ok) against the log, and whether all checkpoints that are absent lie past its end."""
    last = lines.groupBy(*SESSION).agg(F.max("seq").alias("last_seq"))
    j = checkpoints.join(lines.select(*SESSION, "seq", F.col("hash").alias("logged")), [*SESSION, "seq"], "left").join(last, list(SESSION), "left")
    verdict = F.when(~F.col("sig_ok"), "bad_signature").when(F.col("logged").isNull(), "absent").when(F.col("logged") != F.col("hash"), "mismatch").otherwise("agree")
    j = j.withColumn("verdict", verdict)
    g = j.groupBy(*SESSION).agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("agree", "absent", "mismatch", "bad_signature")], F.count_if((F.col("verdict") == "absent") & (F.col("seq") <= F.col("last_seq"))).alias("inside"))
    return g.select(*SESSION, "n_agree", "n_absent", "n_mismatch", "n_bad_signature", ((F.col("n_absent") > 0) & (F.col("inside") == 0)).alias("tail_only"))


def manifest_downgrades(manifests: DataFrame) -> DataFrame:
    """1.x manifests (manifest JSON text) with fields of 2.0."""
    m = manifests.withColumn("version", F.get_json_object("manifest", "$.format_version"))
    fields = F.sort_array(F.array_intersect(F.json_object_keys("manifest"), F.array(*map(F.lit, NEW_FIELDS))))
    return m.withColumn("fields", fields).where(F.startswith("version", F.lit("1.")) & (F.size("fields") > 0)).select("submission_id", "version", "fields")


def report(checks: DataFrame) -> DataFrame:
    """overall per submission over the report's checks: fail, warn if something was skipped, pass; and the failing ones."""
    c = checks.where(F.col("check_id").isin(*CHECKS))
    place = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check_id"))
    g = c.groupBy("submission_id").agg(F.max((F.col("status") == "fail").cast("int") * 2 + (F.col("status") == "skipped").cast("int")).alias("most"), F.sort_array(F.collect_list(F.when(F.col("status") == "fail", F.struct(place.alias("p"), F.col("check_id").alias("c"))))).alias("failed"))
    return g.select("submission_id", F.when(F.col("most") == 2, "fail").when(F.col("most") == 1, "warn").otherwise("pass").alias("overall"), F.array_join(F.transform("failed", lambda x: x["c"]), ", ").alias("detail"))


#: Rule and severity of the checks whose failure is a flag; confidence is 1.
INTEGRITY = {
    "manifest_sig": ("manifest_sig_invalid", "high"),
    "session_binding": ("session_binding_invalid", "high"),
    "chain_integrity": ("chain_broken", "high"),
    "monotonic_t": ("monotonic_t_regression", "medium"),
    "monotonic_wall": ("monotonic_wall_regression", "medium"),
    "submitted_code_match": ("submitted_code_match", "high"),
    "log_bytes_match": ("log_bytes_match", "high"),
    "checkpoint_chain_valid": ("checkpoint_chain_valid", "high"),
    "manifest_downgrade": ("manifest_downgrade", "high"),
}


def integrity_flags(checks: DataFrame) -> DataFrame:
    """A flag for each failing check of INTEGRITY; a check's own override_severity and override_confidence come first."""
    rule = checks.sparkSession.createDataFrame([(k, *v) for k, v in INTEGRITY.items()], "check_id string, heuristic_id string, severity string")
    j = checks.where("status = 'fail'").join(F.broadcast(rule), "check_id")  # a row for each check
    return j.select("submission_id", "heuristic_id", F.coalesce("override_severity", "severity").alias("severity"), F.coalesce("override_confidence", F.lit(1.0)).alias("confidence"))


def seal_reconciliation(seals: DataFrame, sessions: DataFrame, classic: DataFrame) -> DataFrame:
    """Seals without a log, and logs without a seal where there is no classic seal."""
    j = seals.select(*SESSION, F.lit(True).alias("sealed")).join(sessions.select(*SESSION, F.lit(True).alias("logged")), list(SESSION), "full")
    j = j.join(classic.select("submission_id", F.lit(True).alias("classic")).distinct(), "submission_id", "left")
    state = F.when(F.col("logged").isNull(), "seal_without_log").when(F.col("sealed").isNull() & F.col("classic").isNull(), "log_without_seal")
    return j.select(*SESSION, state.alias("state")).where("state is not null")


def seal_union(seals: DataFrame) -> DataFrame:
    """Per submission and path the latest seal's entry (undated ones count as latest, ties go to the later order)."""
    w = W.partitionBy("submission_id", "path").orderBy(F.desc_nulls_first("sealed_at"), F.desc("ord"))
    return seals.withColumn("n", F.row_number().over(w)).where("n = 1").select("submission_id", "path", "sha256", "ord")


def completeness(lines: DataFrame, broken: DataFrame) -> DataFrame:
    """corrupt with a broken chain, complete if the last event ends the session, else dangling."""
    last = lines.groupBy(*SESSION).agg(F.max_by("kind", "seq").alias("kind"))
    j = last.join(broken.select(*SESSION, F.lit(True).alias("broken")).distinct(), list(SESSION), "left")
    return j.select(*SESSION, F.when(F.col("broken"), "corrupt").when(F.col("kind") == "session.end", "complete").otherwise("dangling").alias("state"))
