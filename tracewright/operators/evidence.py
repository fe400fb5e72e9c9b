"""Order of events across sessions, coverage of logs, and rules that compare contents line by line."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.lines import shared_lines
from .checks import SESSION
from .lineage import session_overlaps
from .rules import flag

DIGEST = re.compile(r"[0-9a-f]{64}")
COVERAGE = "submission_id long, session_id string, seal long, final boolean, log string, sealed long, total long, translated boolean, meta string, meta_sealed long, meta_total long"


def prefixes(data: bytes, wanted: set[str]) -> dict[str, int]:
    """digest -> length of the first beginning of the data, cut after a line or at the end, that has it. One pass: the hash of
    a beginning goes on from the one before."""
    found, so_far = {}, hashlib.sha256()
    at = 0
    while True:
        digest = so_far.copy().hexdigest()
        if digest in wanted:
            found.setdefault(digest, at)
        if at == len(data) or len(found) == len(wanted):
            return found
        end = data.find(b"\n", at) + 1 or len(data)
        so_far.update(data[at:end])
        at = end


def log_coverage(text: str, seals: list[dict]) -> list[tuple]:
    """(verdict, sealed, total, translated) of each seal; where lines end with two characters, also as if with one."""
    data = text.encode()
    forms = [data, data.replace(b"\r\n", b"\n")] if b"\r\n" in data else [data]
    whole = [hashlib.sha256(d).hexdigest() for d in forms]
    growing = {s["slog_sha256"] for s in seals if not s["final"] and DIGEST.fullmatch(s["slog_sha256"] or "")}
    found = [prefixes(d, growing) for d in forms]
    out = []
    for s in seals:
        digest, row = s["slog_sha256"], None
        if not DIGEST.fullmatch(digest or ""):
            row = ("unavailable", None, len(data), False)
        for i, d in enumerate(forms):
            if row is None and digest == whole[i]:
                row = ("exact", len(d), len(d), i > 0)
            if row is None and not s["final"] and digest in found[i]:
                row = ("partial", found[i][digest], len(d), i > 0)
        out.append(row or ("no_match", None, len(data), False))
    return out


def meta_coverage(text: str | None, seals: list[dict]) -> list[tuple]:
    """(verdict, sealed, total) of each seal: the meta file is written anew with each checkpoint, so its earlier states are itself
    without the last ones. One pass over the checkpoints."""
    none = [("unavailable", None, None)] * len(seals)
    try:
        meta = json.loads(text or "")
    except ValueError:
        return none
    if not isinstance(meta, dict) or not isinstance(meta.get("checkpoints"), list):
        return none
    plain = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    whole = hashlib.sha256(text.encode()).hexdigest()
    if plain(meta) != text:
        return [("exact", None, None) if s["meta_sha256"] == whole else ("unavailable", None, None) for s in seals]
    entry = lambda k: f"{plain(k)}:{plain(meta[k])}"
    before, after = [entry(k) for k in sorted(meta) if k < "checkpoints"], [entry(k) for k in sorted(meta) if k > "checkpoints"]
    tail = ("]" + "".join("," + x for x in after) + "}").encode()
    so_far = hashlib.sha256(("{" + "".join(x + "," for x in before) + '"checkpoints":[').encode())
    states: dict[str, int] = {}
    for n, c in enumerate([*meta["checkpoints"], None]):
        end = so_far.copy()
        end.update(tail)
        states[end.hexdigest()] = n
        so_far.update((("," if n else "") + plain(c)).encode())
    total, out = len(meta["checkpoints"]), []
    for s in seals:
        digest = s["meta_sha256"]
        if not DIGEST.fullmatch(digest or ""):
            out.append(("unavailable", None, total))
        elif digest == whole:
            out.append(("exact", total, total))
        elif not s["final"] and digest in states:
            out.append(("partial", states[digest], total))
        else:
            out.append(("no_match", None, total))
    return out


def seal_coverage(seals: DataFrame, logs: DataFrame) -> DataFrame:
    """What each seal proves of its session's log and meta file: exact, partial (with how much), no_match, or unavailable where
    nothing can be compared. A final seal holds for the whole file only.

    seals: submission_id, session_id, seal, slog_sha256, meta_sha256, final. logs: submission_id, session_id, log, meta (whole texts). A log
    is hashed once, however many seals it has.
    """
    own = seals.groupBy(*SESSION).agg(F.sort_array(F.collect_list(F.struct(F.col("seal").cast("long").alias("seal"), "slog_sha256", "meta_sha256", F.coalesce("final", F.lit(False)).alias("final")))).alias("seals"))
    fields = to_arrow_schema(StructType.fromDDL(COVERAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                pairs = zip(r["seals"], log_coverage(r["log"] or "", r["seals"]), meta_coverage(r["meta"], r["seals"]), strict=True)
                out = [{"submission_id": r["submission_id"], "session_id": r["session_id"], "seal": s["seal"], "final": s["final"], **dict(zip(("log", "sealed", "total", "translated"), a, strict=True)), **dict(zip(("meta", "meta_sealed", "meta_total"), b, strict=True))} for s, a, b in pairs]
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    return logs.select(F.col("submission_id").cast("long"), "session_id", "log", "meta").join(own, list(SESSION)).mapInArrow(run, COVERAGE)


def watched_files(events: DataFrame) -> DataFrame:
    """Whether a file was watched in all, some or none of its submission's sessions that saw it (watched column)."""
    g = events.groupBy("submission_id", "path").agg(F.bool_and("watched").alias("all"), F.bool_or("watched").alias("some"))
    return g.select("submission_id", "path", F.when(F.col("all"), "all").when(F.col("some"), "some").otherwise("none").alias("watched"))


def git_gaps(events: DataFrame) -> DataFrame:
    """Sessions that observe git, or why they are silent: no repository, no terminal, or unknown."""
    g = events.groupBy(*SESSION).agg(F.count_if(F.col("kind") == "git.event").alias("git"), F.count_if(F.col("kind") == "terminal.open").alias("terminals"), F.bool_or("repository").alias("repository"))
    cause = F.when(F.col("git") > 0, "observing").when(~F.col("repository"), "no_repository").when(F.col("terminals") == 0, "no_terminal").otherwise("unknown")
    return g.select(*SESSION, cause.alias("cause"))


def coverage_facts(capabilities: DataFrame, ranges: DataFrame, gaps: DataFrame, witnesses: DataFrame, torn: DataFrame) -> DataFrame:
    """One sheet per submission: overlaps by judgement, git, silent sessions, witness verdicts, torn tails, and whether
    anything is to be reported."""
    o = session_overlaps(ranges).groupBy("submission_id").agg(F.count(F.lit(1)).alias("overlaps"), F.count_if(F.col("judgement") == "multi_machine").alias("multi_machine"))
    g = gaps.groupBy("submission_id").agg(F.count_if(F.col("cause") != "observing").alias("silent"))
    w = witnesses.groupBy("submission_id").agg(F.count_if(F.col("verdict") == "corroborated").alias("corroborated"), F.count_if(F.col("verdict").isin("absent", "short", "tip_mismatch")).alias("disputed"))
    t = torn.groupBy("submission_id").agg(F.count(F.lit(1)).alias("torn"))
    j = capabilities.select("submission_id", "git")
    for part in (o, g, w, t):
        j = j.join(part, "submission_id", "left")
    j = j.na.fill(0)
    return j.withColumn("reportable", (F.col("multi_machine") > 0) | (F.col("disputed") > 0) | (F.col("torn") > 0))


def mass_replacements(changes: DataFrame, most: float = 0.2) -> DataFrame:
    """Outside changes (before, after: whole contents; saved: a later save exists) that keep less than ``most`` of the lines."""
    lines = lambda c: F.size(F.split(F.regexp_replace(c, "\n$", ""), "\n"))
    c = changes.where("saved and after is not null").withColumn("overlap", shared_lines("before", "after") / F.greatest(lines("before"), lines("after")))
    return flag(c.where(F.col("overlap") < most), "mass_external_replacement", F.lit("high"), F.lit(0.75), "place")


def seal_problems(seals: DataFrame) -> DataFrame:
    """problem of single seals (session_id, manifest text, signature), the first that applies."""
    id_ = F.get_json_object("manifest", "$.session_id")
    problem = (
        F.when(F.col("manifest").isNull(), "missing_manifest").when(F.expr("try_parse_json(manifest)").isNull(), "bad_json")
        .when(id_.isNull() | F.get_json_object("manifest", "$.slog_sha256").isNull(), "bad_shape").when(id_ != F.col("session_id"), "id_mismatch").when(F.col("signature").isNull(), "missing_signature")
    )
    return seals.withColumn("problem", problem).where("problem is not null").select("submission_id", "session_id", "problem")
