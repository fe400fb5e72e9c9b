"""Reconciliation of files, students, rosters and jobs at intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The first file of each blob in a semester, then of each source group; none whose blob is known."""
    first = lambda df, key: df.withColumn("n", F.row_number().over(W.partitionBy("semester_id", F.coalesce(key, F.concat(F.lit("#"), F.col("file_id").cast("string")))).orderBy("file_id"))).where("n = 1").drop("n")
    one = first(files, F.col("blob_sha256"))
    return first(one, F.col("group_key")).join(known.select("semester_id", "blob_sha256"), ["semester_id", "blob_sha256"], "left_anti")


def named_parts(name: Column, pattern: str) -> dict[str, Column]:
    """sid and assignment_id by the pattern's named groups, null where it doesn't match."""
    import re

    places = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return {g: F.when(name.rlike(plain), F.regexp_extract(name, plain, i)) for g, i in places.items()}


def matched_students(files: DataFrame, roster: DataFrame, pattern: str) -> DataFrame:
    """file_id, student_id, assignment, reason (null if matched)."""
    parts = named_parts(F.col("name"), pattern)
    f = files.select("file_id", "manifest_assignment", parts["sid"].alias("sid"), parts["assignment_id"].alias("named"))
    j = f.join(roster.select("sid", F.col("id").alias("student_id")), "sid", "left")
    reason = F.when(F.col("sid").isNull(), "no_filename_match").when(F.col("student_id").isNull(), "unknown_sid")
    return j.select("file_id", "student_id", F.coalesce("named", "manifest_assignment").alias("assignment"), reason.alias("reason"))


def versions(subs: DataFrame) -> DataFrame:
    """version_index by time within (student, assignment), and the latest submission, which supersedes the others."""
    w = W.partitionBy("student_id", "assignment_id").orderBy("ingested_at", "id")
    last = F.last("id").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return subs.select("id", "student_id", "assignment_id", F.row_number().over(w).cast("long").alias("version_index"), F.when(last != F.col("id"), last).alias("superseded_by"))


def group_owners(members: DataFrame, subs: DataFrame) -> DataFrame:
    """Smallest sid of a group submission as owner, unless that owner has a newer submission of the assignment."""
    o = members.groupBy("id").agg(F.min("sid").alias("owner"))
    s = subs.join(o, "id")
    newer = subs.select(F.col("student_sid").alias("owner"), "assignment_id", F.col("ingested_at").alias("other"), F.col("id").alias("other_id")).groupBy("owner", "assignment_id").agg(F.max(F.struct("other", "other_id")).alias("latest"))
    j = s.join(newer, ["owner", "assignment_id"], "left")
    taken = F.coalesce(F.struct("ingested_at", "id") < F.struct(F.col("latest.other").alias("ingested_at"), F.col("latest.other_id").alias("id")), F.lit(False))
    return j.select("id", "assignment_id", F.when(taken, F.col("student_sid")).otherwise(F.col("owner")).alias("owner"))


def roster_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """sid (lower case), change: add, delete, or update where a column differs."""
    a = old.select(F.lower("sid").alias("sid"), F.lit(True).alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = new.select(F.lower("sid").alias("sid"), F.lit(True).alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    change = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "delete").when(differs, "update")
    return a.join(b, "sid", "full").select("sid", change.alias("change")).where("change is not null")


def upserted_roster(roster: DataFrame, submitters: DataFrame) -> DataFrame:
    """Roster with names and e-mails of submitters where they give one; unknown submitters are added."""
    s = submitters.select("sid", F.col("display_name").alias("new_name"), F.col("email").alias("new_email"))
    j = roster.select("sid", "display_name", "email").join(s, "sid", "full")
    return j.select("sid", F.coalesce("new_name", "display_name").alias("display_name"), F.coalesce("new_email", "email").alias("email"))


def identity_links(roster: DataFrame, identities: DataFrame) -> DataFrame:
    """id, identity_id: kept where set, else that of the same e-mail."""
    i = identities.select(F.lower("email").alias("mail"), F.col("identity_id").alias("found"))
    return roster.withColumn("mail", F.lower("email")).join(i, "mail", "left").select("id", F.coalesce("identity_id", "found").alias("identity_id"))


def ingest_jobs(files: DataFrame) -> DataFrame:
    """Counts by status, and the state they give; a cancelled job stays cancelled."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = files.groupBy("job").agg(F.count(F.lit(1)).alias("n"), n("matched").alias("n_matched"), n("failed", "unmatched", "discarded").alias("n_bad"), n("pending").alias("n_pending"), F.max((F.col("cancelled")).cast("int")).alias("c"))
    state = F.when(F.col("c") == 1, "cancelled").when(F.col("n_pending") > 0, "running").when(F.col("n_bad") > 0, "partial").otherwise("succeeded")
    return g.select("job", "n", "n_matched", "n_bad", "n_pending", state.alias("state"))


def failure_causes(files: DataFrame) -> DataFrame:
    """n by phase and cause of the error text (JSON)."""
    return files.where("error is not null").groupBy(F.get_json_object("error", "$.phase").alias("phase"), F.get_json_object("error", "$.cause").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def phase_profile(timings: DataFrame) -> DataFrame:
    """Total, count, largest and share of all time per phase."""
    g = timings.groupBy("phase").agg(F.sum("ms").alias("total"), F.count(F.lit(1)).alias("n"), F.max("ms").alias("largest"))
    all_ = g.agg(F.sum("total").alias("all"))
    return g.crossJoin(F.broadcast(all_)).select("phase", "total", "n", "largest", F.round(F.col("total") / F.col("all"), 6).alias("share"))  # one row


def expired(subs: DataFrame, semesters: DataFrame, today: str) -> DataFrame:
    """Submissions of semesters archived for longer than their retention (days)."""
    old = semesters.where(F.date_add(F.to_date("archived_at"), F.col("retention_days")) < F.to_date(F.lit(today))).select("semester_id")
    return subs.join(old, "semester_id", "left_semi").select("id", "semester_id")


def usage(files: DataFrame, quota: int, warn: float = 0.8, critical: float = 0.95) -> DataFrame:
    g = files.groupBy("owner").agg(F.sum("bytes").alias("bytes"))
    share = F.col("bytes") / quota
    return g.select("owner", "bytes", F.when(share >= critical, "critical").when(share >= warn, "warn").otherwise("ok").alias("level"))


def same_artifacts(a: DataFrame, b: DataFrame) -> DataFrame:
    """artifact, same: whether both sides have the same entry names and digests."""
    j = a.select("artifact", "name", F.col("sha256").alias("x")).join(b.select("artifact", "name", F.col("sha256").alias("y")), ["artifact", "name"], "full")
    return j.groupBy("artifact").agg(F.bool_and(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("same"))


def glob_to_regex(glob: Column) -> Column:
    """** crosses folders, * does not."""
    plain = F.regexp_replace(glob, r"([.+^$()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(plain, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def selected_scopes(scopes: DataFrame, assignments: DataFrame) -> DataFrame:
    """submission_id, prefix, accepted, reason under the assignment's mode: self_identifying, bundle, whole_repo, scoped."""
    j = scopes.join(assignments, "assignment_id").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("submission_id")))
    root = F.col("prefix") == ""
    inside = F.rlike("prefix", glob_to_regex(F.col("path_glob")))
    mode = F.col("mode")
    reason = (
        F.when(~F.col("has_manifest"), "no_manifest")
        .when((mode == "bundle") & ((F.col("n") != 1) | ~root), "submission_type_mismatch")
        .when((mode == "whole_repo") & ~root, "scope_excluded")
        .when((mode == "scoped") & ~inside, "scope_excluded")
    )
    j = j.withColumn("reason", reason)
    several = F.count_if(F.col("reason").isNull()).over(W.partitionBy("submission_id", "declared")) > 1
    reason = F.when(F.col("reason").isNull() & several & (F.col("on_multiple") == "error"), "ambiguous_scope").otherwise(F.col("reason"))
    return j.select("submission_id", "prefix", reason.isNull().alias("accepted"), reason.alias("reason"))


def one_submitter_per_sid(rows: DataFrame) -> DataFrame:
    """Name and e-mail from the first record of a sid that has them."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    return rows.groupBy("sid").agg(first("display_name"), first("email"))


def within_limits(bundles: DataFrame, bundle_bytes: int, batch_files: int) -> DataFrame:
    """Bundles not too large, with their running size; none at all of a batch with more files than allowed."""
    ok = bundles.where(F.col("bytes") <= bundle_bytes)
    w = W.partitionBy("batch").orderBy("position")
    o = ok.withColumn("running", F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("files", F.count(F.lit(1)).over(W.partitionBy("batch")))
    return o.where(F.col("files") <= batch_files).select("batch", "position", "bytes", "running")
