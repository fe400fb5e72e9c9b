"""Contents of files: replay of edits with the origin of every character, and statistics per file.

Edits of one file depend on each other, so a file is replayed by one task; only events that change content go there, and
what comes back are runs of characters of one origin. Positions count UTF-16 units, as the log does.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.lines import common_lines, split_lines
from .checks import SESSION
from .rules import utf16_length

FILE = ("submission_id", "path")
CONTENT_KINDS = ("doc.open", "doc.change", "paste", "fs.external_change", "doc.save")


class Buffer:
    """A file as lines of (text, origins); an edit touches its own lines only."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, list[int]]] = [("", [])]

    def set(self, text: str, origins: list[int]) -> None:
        self.lines, at = [], 0
        for line in text.split("\n"):
            self.lines.append((line, origins[at : at + len(line)] + origins[at + len(line) : at + len(line) + 1]))
            at += len(line) + 1

    def text(self) -> str:
        return "\n".join(t for t, _ in self.lines)

    def origins(self) -> list[int]:
        flat = [o for _, own in self.lines for o in own]
        return flat[: len(self.text())]

    def replace(self, start: tuple[int, int], end: tuple[int, int], text: str, origin: int) -> bool:
        """False if the range isn't within the file."""
        (l1, c1), (l2, c2) = start, end
        if not (0 <= l1 <= l2 < len(self.lines)) or c1 > len(self.lines[l1][0]) or c2 > len(self.lines[l2][0]) or (l1 == l2 and c1 > c2):
            return False
        head, tail = self.lines[l1], self.lines[l2]
        new = text.split("\n")
        made: list[tuple[str, list[int]]] = [(x, [origin] * (len(x) + (k < len(new) - 1))) for k, x in enumerate(new)]
        made[0] = (head[0][:c1] + made[0][0], head[1][:c1] + made[0][1])
        made[-1] = (made[-1][0] + tail[0][c2:], made[-1][1] + tail[1][c2:])
        self.lines[l1 : l2 + 1] = made
        return True


def units(text: str) -> str:
    """Every UTF-16 unit as one character, so that indexes agree with the log's."""
    return text if text.isascii() else "".join(map(chr, memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H")))


def from_units(text: str) -> str:
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def sha256(text: str) -> str:
    return hashlib.sha256(from_units(text).encode()).hexdigest()


def runs_of(origins: list[int]) -> list[dict]:
    out: list[dict] = []
    for at, o in enumerate(origins):
        if out and out[-1]["event_seq"] == o:
            out[-1]["length"] += 1
        else:
            out.append({"offset": at, "length": 1, "event_seq": o})
    return out


def merged_external(old: str, origins: list[int], new: str, origin: int) -> list[int]:
    """Origins after an outside change: unchanged lines keep theirs."""
    a, b = split_lines(old), split_lines(new)
    starts = [0]
    for x in a:
        starts.append(starts[-1] + len(x))
    kept = {j: i for i, j in common_lines(a, b)}
    out: list[int] = []
    for j, line in enumerate(b):
        out += origins[starts[kept[j]] : starts[kept[j] + 1]] if j in kept else [origin] * len(line)
    return out


STATE = "submission_id long, path string, global_idx long, content string, sha256 string, length long, tainted boolean, runs array<struct<offset:int,length:int,event_seq:long>>"


def replay(events: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """State of every file at the given places (submission_id, path, cut; the state before that event), else at its end.

    events: submission_id, path, global_idx, kind, content (whole text of opens and outside changes; text of pastes and
    changes), start_line, start_char, end_line, end_char. An edit that doesn't fit taints the file and is left out. A
    null position appends.
    """
    rows = events.where(F.col("kind").isin(*CONTENT_KINDS)).select("submission_id", "path", "global_idx", "kind", "content", "start_line", "start_char", "end_line", "end_char", F.lit(False).alias("cut"))
    if cuts is not None:
        none = [F.lit(None).cast(t) for t in ("string", "string", "int", "int", "int", "int")]
        rows = rows.unionAll(cuts.select("submission_id", "path", F.col("cut").alias("global_idx"), *none, F.lit(True)))
    whole = cuts is None

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["global_idx", "cut"], ascending=[True, False], kind="stable")
        buffer, tainted, out = Buffer(), False, []

        def state(at: int) -> tuple:
            text = buffer.text()
            return (int(pdf["submission_id"].iloc[0]), pdf["path"].iloc[0], at, from_units(text), sha256(text), len(text), tainted, runs_of(buffer.origins()))

        for r in pdf.itertuples(index=False):
            if r.cut:
                out.append(state(int(r.global_idx)))
            elif r.kind == "doc.save":
                continue
            elif r.content is None:
                tainted = True
            elif r.kind in ("doc.open", "fs.external_change"):
                new = units(r.content)
                buffer.set(new, [int(r.global_idx)] * len(new) if r.kind == "doc.open" else merged_external(buffer.text(), buffer.origins(), new, int(r.global_idx)))
            else:
                last = len(buffer.lines) - 1
                here = (last, len(buffer.lines[last][0]))
                start = here if pd.isna(r.start_line) else (int(r.start_line), int(r.start_char))
                end = here if pd.isna(r.end_line) else (int(r.end_line), int(r.end_char))
                tainted |= not buffer.replace(start, end, units(r.content), int(r.global_idx))
        if whole:
            out.append(state(int(pdf["global_idx"].max())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")[:7]] + ["runs"])

    return rows.groupBy(*FILE).applyInPandas(fold, STATE)


def run_table(states: DataFrame, kinds: DataFrame) -> DataFrame:
    """Runs with the kind of the event that made them."""
    r = states.select(*FILE, F.explode("runs").alias("r")).select(*FILE, "r.offset", "r.length", "r.event_seq")
    return r.join(kinds.select("submission_id", F.col("global_idx").alias("event_seq"), "kind"), ["submission_id", "event_seq"], "left")


def line_origins(states: DataFrame) -> DataFrame:
    """Latest event that touched each line of a file."""
    s = states.select(*FILE, F.split("content", "\n").alias("lines"), "runs")
    lengths = F.transform("lines", lambda x: utf16_length(x) + 1)
    s = s.withColumn("ends", F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)))
    e = s.select(*FILE, "runs", F.posexplode(F.arrays_zip(F.col("ends").alias("stop"), F.col("lines").alias("line"))).alias("nr", "l"))
    start = F.col("l.stop") - utf16_length(F.col("l.line")) - 1
    touching = F.filter("runs", lambda r: (r["offset"] < F.col("l.stop")) & (r["offset"] + r["length"] > start))
    return e.select(*FILE, F.col("nr").cast("long").alias("line"), F.array_max(F.transform(touching, lambda r: r["event_seq"])).alias("last_event"))


def recovered_pastes(pastes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Content of pastes (sha256, head, tail, bytes) too large to be logged, from earlier blobs of the same hash."""
    b = blobs.select("submission_id", "sha256", F.col("content").alias("blob"), F.col("global_idx").alias("seen"))
    j = pastes.join(b, ["submission_id", "sha256"]).where("seen < global_idx")
    j = j.where(F.startswith("blob", F.col("head")) & F.endswith("blob", F.col("tail")) & (F.octet_length("blob") == F.col("bytes")))
    return j.groupBy("submission_id", "global_idx").agg(F.max_by("blob", "seen").alias("content"))


def self_inflicted(events: DataFrame, within_ms: int = 1000) -> DataFrame:
    """External changes that the editor's own save explains: the next content event of the file is a save of that hash
    within the time, or the latest save before it in the session has it."""
    w = W.partitionBy(*SESSION, "path").orderBy("global_idx")
    content = F.when(F.col("kind").isin("doc.save", "doc.change", "paste"), F.struct("kind", "sha256", "ms"))
    nxt = F.first(content, True).over(w.rowsBetween(1, W.unboundedFollowing))
    before = F.last(F.when(F.col("kind") == "doc.save", F.col("sha256")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    e = events.withColumn("nxt", nxt).withColumn("before", before).where("kind = 'fs.external_change'")
    own = ((F.col("nxt.kind") == "doc.save") & (F.col("nxt.sha256") == F.col("sha256")) & (F.col("nxt.ms") - F.col("ms") <= within_ms)) | (F.col("before") == F.col("sha256"))
    return e.where(F.coalesce(own, F.lit(False))).select(*SESSION, "path", "global_idx")


def file_stats(events: DataFrame) -> DataFrame:
    """typed, pasted and external characters (UTF-16 units) and saves per file."""
    n = utf16_length("text")
    return events.groupBy(*FILE).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "doc.change", n)), F.lit(0)).alias("typed"), F.coalesce(F.sum(F.when(F.col("kind") == "paste", n)), F.lit(0)).alias("pasted"),
        F.coalesce(F.sum(F.when(F.col("kind") == "fs.external_change", F.col("diff_size"))), F.lit(0)).alias("external"), F.count_if(F.col("kind") == "doc.save").alias("saves"),
    )


def active_time(events: DataFrame, limit_ms: int = 60000) -> DataFrame:
    """Sums of gaps between neighbours: under the limit active, else idle; gaps that go back don't count."""
    gap = F.col("ms") - F.lag("ms").over(W.partitionBy("submission_id").orderBy("global_idx"))
    e = events.withColumn("gap", gap).where("gap >= 0")
    return e.groupBy("submission_id").agg(F.coalesce(F.sum(F.when(F.col("gap") < limit_ms, F.col("gap"))), F.lit(0)).alias("active_ms"), F.coalesce(F.sum(F.when(F.col("gap") >= limit_ms, F.col("gap"))), F.lit(0)).alias("idle_ms"))


def terminal_spans(events: DataFrame) -> DataFrame:
    """Each open with the first close of its terminal after it that no earlier open has taken, by seq; else null.

    Taking closes in order is a running balance: the close that an open takes has the rank of the open plus the closes
    that came when none was open.
    """
    w = W.partitionBy(*SESSION, "terminal").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "terminal.open", 1).otherwise(-1)
    e = events.withColumn("level", F.sum(step).over(w)).withColumn("wasted", -F.least(F.lit(0), F.min("level").over(w)))
    e = e.withColumn("opens", F.sum((F.col("kind") == "terminal.open").cast("int")).over(w)).withColumn("closes", F.sum((F.col("kind") == "terminal.close").cast("int")).over(w))
    used = e.where("kind = 'terminal.close'").withColumn("nth", F.col("closes") - F.col("wasted")).groupBy(*SESSION, "terminal", "nth").agg(F.min_by("t", "seq").alias("closed"))
    opens = e.where("kind = 'terminal.open'").select(*SESSION, "terminal", "seq", "t", F.col("opens").alias("nth"))
    return opens.join(used, [*SESSION, "terminal", "nth"], "left").select(*SESSION, "terminal", "seq", (F.col("closed") - F.col("t")).alias("open_ms"))


def start_lengths(opens: DataFrame) -> DataFrame:
    """Length of the first open's content, 0 without one."""
    return opens.groupBy(*FILE).agg(F.coalesce(utf16_length(F.min_by("content", "global_idx")), F.lit(0)).alias("start_length"))


def stats_rollup(files: DataFrame, events: DataFrame) -> DataFrame:
    f = files.groupBy("submission_id").agg(F.sum("typed").alias("typed"), F.sum("pasted").alias("pasted"), F.sum("saves").alias("saves"), F.count(F.lit(1)).alias("files"))
    s = events.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"), (F.max("ms") - F.min("ms")).alias("span")).groupBy("submission_id").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("sessions"), F.sum("span").alias("span_ms"))
    return f.join(s, "submission_id")


ROLES = ("excluded", "ignored", "attachment", "reviewed")
LISTS = {"ignore": "ignored", "attachments": "attachment", "track": "reviewed"}


def entry_matches(path: Column, entry: Column) -> Column:
    """Entries are exact, a folder with a slash at its end, or * and a suffix."""
    return (path == entry) | (F.endswith(entry, F.lit("/")) & F.startswith(path, entry)) | (F.startswith(entry, F.lit("*")) & F.endswith(path, F.substring(entry, 2, 10_000)))


def path_roles(paths: DataFrame, rules: DataFrame, excluded_prefix: str) -> DataFrame:
    """role of each path: excluded, ignored, attachment, reviewed or unscoped, the first that applies.

    Rules (list, entry) of a submission's manifest are few; they meet the paths by submission.
    """
    r = rules.select("submission_id", "list", "entry").where("entry is not null")
    m = paths.join(r, "submission_id", "left").withColumn("role", F.when(entry_matches(F.col("path"), F.col("entry")), F.element_at(F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv]), F.col("list"))))
    m = m.withColumn("role", F.when(F.startswith("path", F.lit(excluded_prefix)), "excluded").otherwise(F.col("role")))
    g = m.groupBy("submission_id", "path").agg(F.min(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))).alias("first"))
    return g.select("submission_id", "path", F.coalesce(F.get(F.array(*map(F.lit, ROLES)), (F.col("first") - 1).cast("int")), F.lit("unscoped")).alias("role"))


def scope_problems(rules: DataFrame) -> DataFrame:
    """problem of bad scope entries, the first that applies."""
    e = F.col("entry")
    problem = (
        F.when(e.isNull() | (F.trim(e) == ""), "empty").when(F.startswith(e, F.lit("/")) | e.rlike("^[A-Za-z]:"), "absolute").when(F.contains(e, F.lit("\\")), "backslash")
        .when(e.rlike(r"(^|/)\.{1,2}(/|$)"), "dot_segment").when(F.contains(e, F.lit("//")), "empty_segment")
        .when(F.contains(F.substring(e, 2, 10_000), F.lit("*")) | (e == "*"), "bad_wildcard").when(F.startswith(e, F.lit("*")) & (F.contains(e, F.lit("/"))), "bad_wildcard")
    )
    return rules.withColumn("problem", problem).where("problem is not null")
