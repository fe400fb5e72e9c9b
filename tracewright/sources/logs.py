"""Scans of log files, manifests, rosters and listings, and sinks. Schemas are declared, never inferred; what doesn't
fit is returned as rejects, with its place."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.staging import new_path

ENVELOPE = "seq long, t double, wall string, kind string, prev_hash string, hash string"
META = "session_id string, pubkey string, checkpoints array<struct<seq:long,hash:string,sig:string>>"
MANIFEST = "format_version string, sessions array<struct<session_id:string,slog_sha256:string,meta_sha256:string>>, submission_files array<struct<path:string,role:string,sha256:string>>"
HEX = "^[0-9a-f]{64}$"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) with envelope columns, data as text, and error (null if the shape is right)."""
    e = lines.withColumn("e", F.from_json("line", ENVELOPE)).withColumn("data", F.get_json_object("line", "$.data"))
    error = (
        F.when(F.col("e").isNull() | F.col("e.seq").isNull() | F.col("e.t").isNull(), "not_an_envelope")
        .when(F.col("e.kind").isNull() | F.col("e.wall").isNull(), "missing_field")
        .when(~F.coalesce(F.col("e.hash"), F.lit("")).rlike(HEX) | ~F.coalesce(F.col("e.prev_hash"), F.lit("")).rlike(HEX), "bad_hash")
    )
    kept = [c for c in lines.columns if c not in ("file", "line_no", "line")]
    return e.select("file", "line_no", "line", "e.*", "data", error.alias("error"), *kept)


def whole_files(files: DataFrame) -> DataFrame:
    """Lines of files (file, text), numbered from 1. Only an unterminated last line may be torn: it is marked."""
    split = files.select("file", F.split("text", "\n").alias("lines"))
    s = split.select("file", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    last = F.col("i") == F.col("n") - 1
    return s.where(~(last & (F.col("line") == ""))).select("file", (F.col("i") + 1).cast("long").alias("line_no"), "line", last.alias("unterminated"))


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, rejects and torn tails of the NDJSON files under a path; ``file`` is the whole path, since logs of several
    submissions have one name. A log is a session's, a few megabytes: a row holds it until its lines are cut."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    p = parsed_lines(whole_files(files))
    return p.where("error is null").drop("error", "unterminated"), p.where("error is not null and not unterminated"), p.where("error is not null and unterminated").select("file", "line_no", "line")


def checkpoints(metas: DataFrame) -> DataFrame:
    """seq, hash, sig of the checkpoints in session metas (file, text)."""
    m = metas.withColumn("m", F.from_json("text", META))
    return m.select("file", "m.session_id", F.explode("m.checkpoints").alias("c")).select("file", "session_id", "c.seq", "c.hash", "c.sig")


def manifest_parts(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session digests and submitted files of manifests (submission_id, text)."""
    m = manifests.withColumn("m", F.from_json("text", MANIFEST))
    sessions = m.select("submission_id", F.inline("m.sessions"))
    return sessions, m.select("submission_id", F.inline("m.submission_files"))


def assembled(events: DataFrame, metas: DataFrame) -> DataFrame:
    """session_id, error: the log must start with session.start and name the session its meta names."""
    first = events.groupBy("file").agg(F.min_by("kind", "seq").alias("first"), F.min_by("named", "seq").alias("named"))
    j = first.join(metas.select("file", F.col("session_id").alias("meta_id")), "file", "left")
    error = F.when(F.col("first") != "session.start", "no_session_start").when(F.col("meta_id").isNull(), "no_meta").when(F.col("meta_id") != F.col("named"), "session_id_mismatch")
    return j.select("file", F.col("named").alias("session_id"), error.alias("error"))


REQUIRED = ("sid", "display_name", "email")


def roster_rows(raw: DataFrame, position: str) -> DataFrame:
    """Rows of a roster as read (any column names, all text): sid, display_name, email, extras, error.

    Headers count without case, byte order mark and blanks; of rows with one sid (without case) the first is right.
    """
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns if c != position}
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"roster without {', '.join(missing)}")
    cell = lambda c: F.trim(F.col(f"`{c}`"))
    others = [n for n in names if n not in REQUIRED]
    extras = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*[cell(names[n]) for n in others])) if others else F.create_map().cast("map<string,string>")
    r = raw.select(position, *[F.nullif(cell(names[c]), F.lit("")).alias(c) for c in REQUIRED], extras.alias("extras"))
    nth = F.row_number().over(W.partitionBy(F.lower("sid")).orderBy(position))
    error = F.when(F.col("sid").isNull(), "no_sid").when(F.col("display_name").isNull(), "no_name").when(nth > 1, "duplicate_sid")
    return r.withColumn("error", error)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True).withColumn("row_no", F.monotonically_increasing_id())
    return roster_rows(raw, "row_no")


def submitters(metadata: DataFrame) -> DataFrame:
    """One row per submitter with a sid of submissions (submission_id, submitters array of structs sid, name)."""
    e = metadata.select("submission_id", F.explode_outer("submitters").alias("s"))
    sid = F.trim(F.col("s.sid").cast("string"))
    return e.select("submission_id", sid.alias("sid"), F.trim("s.name").alias("display_name")).where("sid is not null and sid <> ''")


JUNK = r"(^|/)(__MACOSX|\.git|node_modules)/|(^|/)\.DS_Store$"


def recording_scopes(listing: DataFrame, mark: str) -> DataFrame:
    """submission_id, path, scope: the deepest folder above a file that holds a folder ``mark`` (with a slash); null without one."""
    f = listing.where(~F.col("path").rlike(JUNK))
    own = f.where(F.contains("path", F.lit(mark))).select("submission_id", F.regexp_extract("path", rf"^(.*?){re.escape(mark)}", 1).alias("scope")).where("scope = '' or scope like '%/'").distinct()
    # A file's folders, each an equal key: no scope is compared with files it can't own.
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    a = f.select("submission_id", "path", F.explode(above).alias("scope"))
    best = a.join(own, ["submission_id", "scope"]).groupBy("submission_id", "path").agg(F.max_by("scope", F.length("scope")).alias("scope"))
    return f.select("submission_id", "path").join(best, ["submission_id", "path"], "left")


def selected_entries(listing: DataFrame, manifest: DataFrame, prefix: str) -> DataFrame:
    """Log files and files of the manifest; a path under the prefix wins over a bare one of the same name."""
    bare = F.when(F.startswith("path", F.lit(prefix)), F.substring("path", len(prefix) + 1, 10_000)).otherwise(F.col("path"))
    e = listing.withColumn("name", bare).withColumn("under", F.startswith("path", F.lit(prefix)))
    e = e.withColumn("n", F.row_number().over(W.partitionBy("submission_id", "name").orderBy(F.desc("under"), "path"))).where("n = 1")
    known = manifest.select("submission_id", F.col("path").alias("name"), F.lit(True).alias("listed")).distinct()
    return e.join(known, ["submission_id", "name"], "left").where(F.col("listed") | F.col("name").rlike(r"\.(slog|meta|seal)$")).select("submission_id", "name", "path")


#: Fixed value: most rows of a cohort export. The cap is part of the export's contract.
EXPORT_ROWS = 10_000


def exported(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    return rows.select(*columns).orderBy(*order).limit(EXPORT_ROWS)


def write_export(rows: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    exported(rows, columns, order).coalesce(1).write.csv(path, header=True)


def findings(checks: DataFrame, flags: DataFrame, cross: DataFrame, events: DataFrame) -> DataFrame:
    """One table of a report's sections: submission_id, section, place, text; last the events (global_idx, kind) that flags
    refer to (supporting: an event's global_idx), each once."""
    referred = flags.select("submission_id", F.col("supporting").alias("global_idx")).distinct().join(events.select("submission_id", "global_idx", "kind"), ["submission_id", "global_idx"])
    part = lambda df, nr, place, text: df.select("submission_id", F.lit(nr).alias("section"), place.cast("long").alias("place"), text.alias("text"))
    return part(checks, "1 validation", F.col("place"), F.concat_ws(": ", "check_id", "status")).unionAll(part(flags, "2 flags", F.col("place"), F.concat_ws(" ", "severity", "heuristic_id"))).unionAll(part(cross, "3 cross flags", F.col("flag_id"), F.col("severity"))).unionAll(part(referred, "4 events", F.col("global_idx"), F.col("kind")))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` are replaced; other rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values by key; columns that a new row leaves null keep their stored value."""
    values = [c for c in old.columns if c not in keys]
    j = old.alias("o").join(new.alias("n"), keys, "full")
    return j.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values])


def round_trip(lines: DataFrame) -> DataFrame:
    """Writes lines (one column ``line``) as text files and scans them as one log per file."""
    spark = lines.sparkSession
    path = new_path(spark, "log")
    lines.write.text(path)
    return read_log(spark, path)[0]


