"""Versions of files: what each event makes of the text, with its origins, why it can't be trusted, what each save holds, and
which text a file has when several people's sessions aren't in one order.

A file's events depend on each other, so one task folds them in order, as a stream: it holds the file's tree of pieces and
nothing else, however many events there are. Positions count UTF-16 units, as the log does.

Rules of the fold: an open with its content sets the text and clears doubt; a change or a paste replaces its range (positions
beyond a line or the text are its end); a paste without content, neither recovered from a state with its hash, leaves
doubt; an outside change sets the text (lines that stay keep their origin), or leaves doubt without content, or empties the file when it deletes. An
outside change that the editor's own save explains (``own``) is left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions import rope
from ..functions.lines import common_lines, split_lines
from .checks import SESSION
from .contents import CONTENT_KINDS, FILE, from_units, sha256, units
from .reachability import doors
from .rules import utf16_length

#: States of a file that a late save may still hold.
RECENT = 32
RANGE = ("start_line", "start_char", "end_line", "end_char")


def folded(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], start: Callable[[dict], object], schema: str) -> DataFrame:
    """Folds the rows of each key in order, one after the other: ``start`` makes a state from the first row; its ``step`` takes
    a row and its ``finish`` nothing, and both give rows of the schema."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    now = tuple(r[c] for c in keys)
                    if state is None or now != key:
                        out += state.finish() if state is not None else []
                        key, state = now, start(r)
                    out += state.step(r)
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_pylist(out, schema=fields)
                        out = []
        out += state.finish() if state is not None else []
        yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Version:
    """A file's text and doubts after some of its events. Versions aren't changed; ``after`` gives the next one."""

    __slots__ = ("tree", "tainted", "reasons", "dirty")

    def __init__(self, tree: rope.Node | None = None, tainted: bool = False, reasons: tuple = (), dirty: tuple[int, int] | None = None):
        #: reasons is a chain (earlier, event, reason); dirty the least prefix and suffix that edits have left alone.
        self.tree, self.tainted, self.reasons, self.dirty = tree, tainted, reasons, dirty

    def text(self) -> str:
        return rope.text(self.tree)

    def touched(self, start: int, tail: int) -> tuple[int, int]:
        return (start, tail) if self.dirty is None else (min(start, self.dirty[0]), min(tail, self.dirty[1]))

    def whole(self, new: str, origin: int, keep: bool, tainted: bool, reasons: tuple) -> Version:
        if not keep:
            return Version(rope.made(new, origin), tainted, reasons, (0, 0))
        a, b = split_lines(self.text()), split_lines(new)
        starts = [0]
        for x in a:
            starts.append(starts[-1] + len(x))
        kept, tree = {j: i for i, j in common_lines(a, b)}, None
        for j, line in enumerate(b):
            if j in kept:
                own = rope.part(self.tree, starts[kept[j]], starts[kept[j] + 1])
                tree = rope.join(tree, own)
            else:
                tree = rope.join(tree, rope.made(line, origin))
        return Version(tree, tainted, reasons, (0, 0))

    def after(self, r: dict, recovered: str | None = None) -> Version:
        kind, content, at = r["kind"], r["content"], r["global_idx"]
        if kind == "doc.open":
            return self if content is None else self.whole(units(content), at, False, False, self.reasons)
        if kind == "fs.external_change":
            if r.get("own"):
                return self
            reasons = (self.reasons, at, "fs_external_change")
            if r.get("operation") == "delete":
                return Version(None, True, reasons, (0, 0))
            return Version(self.tree, True, reasons, self.dirty) if content is None else self.whole(units(content), at, True, self.tainted, reasons)
        if kind == "paste" and content is None:
            reasons = (self.reasons, at, "large_paste")
            return Version(self.tree, True, reasons, self.dirty) if recovered is None else self._spliced(r, recovered, reasons)
        if kind in ("doc.change", "paste") and content is not None:
            return self._spliced(r, content, self.reasons)
        return self

    def _spliced(self, r: dict, content: str, reasons: tuple) -> Version:
        end = rope.size(self.tree)
        start = end if r["start_line"] is None else rope.place(self.tree, r["start_line"], r["start_char"])
        stop = end if r["end_line"] is None else rope.place(self.tree, r["end_line"], r["end_char"])
        tree = rope.replaced(self.tree, start, stop, units(content), r["global_idx"])
        return Version(tree, self.tainted, reasons, self.touched(min(start, stop), end - max(start, stop)))

    def reason_list(self) -> list[dict]:
        out, chain = [], self.reasons
        while chain:
            chain, at, reason = chain
            out.append({"global_idx": at, "reason": reason})
        return out[::-1]


def inputs(events: DataFrame, *more: str) -> DataFrame:
    """The columns of content events that the fold reads; those that are absent are null."""
    wanted = {"content": "string", "sha256": "string", "operation": "string", "own": "boolean", **dict.fromkeys(RANGE, "int")}
    known = [F.col(c).cast(t).alias(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()]
    return events.where(F.col("kind").isin(*CONTENT_KINDS)).select(*FILE, "session_id", "seq", F.col("global_idx").cast("long").alias("global_idx"), "kind", *known, *more)


STATES = (
    "submission_id long, path string, content string, sha256 string, length long, tainted boolean, reasons array<struct<global_idx:bigint,reason:string>>, "
    "suppressed array<bigint>, recovered array<bigint>, runs array<struct<offset:int,length:int,event_seq:bigint>>, saves array<struct<session_id:string,seq:bigint,recorded:string,replayed:string>>"
)


class Final:
    """Ends as a file's last state. Pastes too large to be logged are looked up among earlier states by their hash; only
    states whose recorded hash a paste asks for are kept (``wanted``)."""

    def __init__(self, r: dict):
        self.file, self.now = {c: r[c] for c in FILE}, Version()
        self.wanted, self.blobs = set(r["wanted"] or ()), {}
        self.suppressed, self.recovered, self.saves = [], [], []

    def remember(self, recorded: str | None, text: str) -> None:
        if recorded in self.wanted and recorded not in self.blobs and sha256(text) == recorded:
            self.blobs[recorded] = from_units(text)

    def step(self, r: dict) -> list[dict]:
        at, found = r["global_idx"], None
        if r["kind"] == "paste" and r["content"] is None:
            found = self.blobs.get(r["sha256"])
            self.recovered += [at] if found is not None else []
        elif r["kind"] == "fs.external_change" and r["own"]:
            self.suppressed.append(at)
        self.now = self.now.after(r, found)
        if r["kind"] == "doc.save":
            text = self.now.text()
            self.saves.append({"session_id": r["session_id"], "seq": r["seq"], "recorded": r["sha256"], "replayed": sha256(text)})
            self.remember(r["sha256"], text)
        elif r["kind"] == "doc.open" and r["content"] is not None and self.wanted:
            self.remember(sha256(units(r["content"])), units(r["content"]))
        return []

    def finish(self) -> list[dict]:
        text = self.now.text()
        runs = [{"offset": a, "length": n, "event_seq": o} for a, n, o in rope.runs(self.now.tree)]
        return [self.file | {"content": from_units(text), "sha256": sha256(text), "length": len(text), "tainted": self.now.tainted, "reasons": self.now.reason_list(), "suppressed": self.suppressed, "recovered": self.recovered, "runs": runs, "saves": self.saves}]


def file_states(events: DataFrame) -> DataFrame:
    """Every file's last state: text, origins, doubt with its reasons in order, left-out and recovered events, and each save's
    recorded and replayed hash.

    events: submission_id, path, session_id, seq, global_idx, kind, content, sha256, range; own and operation of outside changes.
    """
    rows = inputs(events)
    wanted = rows.where("kind = 'paste' and content is null and sha256 is not null").groupBy(*FILE).agg(F.collect_set("sha256").alias("wanted"))
    return folded(rows.join(wanted, list(FILE), "left"), FILE, ("global_idx",), Final, STATES)


CHANGES = "submission_id long, path string, cut long, length long, breaks long, tainted boolean, prefix long, suffix long, inserted string, runs array<struct<length:int,event_seq:bigint>>"


class Cuts:
    """Gives at every cut what changed since the last one."""

    def __init__(self, r: dict):
        self.file, self.now, self.last = {c: r[c] for c in FILE}, Version(dirty=None), 0

    def step(self, r: dict) -> list[dict]:
        if not r["cut"]:
            self.now = self.now.after(r)
            return []
        now = self.now
        size = rope.size(now.tree)
        prefix, suffix = (size, 0) if now.dirty is None else now.dirty
        new = rope.part(now.tree, prefix, size - suffix)
        self.now = Version(now.tree, now.tainted, now.reasons, None)
        row = {"cut": r["global_idx"], "length": size, "breaks": rope.breaks(now.tree), "tainted": now.tainted, "prefix": prefix, "suffix": suffix, "inserted": from_units(rope.text(new)), "runs": [{"length": n, "event_seq": o} for _, n, o in rope.runs(new)]}
        return [self.file | row]

    def finish(self) -> list[dict]:
        return []


def changes_at(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """At every cut (submission_id, path, cut: the state before that event) what changed since the cut before it: the first
    ``prefix`` and the last ``suffix`` characters are as they were, ``inserted`` with its ``runs`` is between them. A cut costs what changed, not the file.
    """
    rows = inputs(events, F.lit(False).alias("cut"))
    asked = cuts.select(F.col("submission_id"), F.col("path"), F.col("cut").cast("long").alias("at")).distinct()
    asked = asked.select(*FILE, F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("long").alias("seq"), F.col("at").alias("global_idx"), F.lit("cut").alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("content", "sha256", "operation", "own", *RANGE)], F.lit(True).alias("cut"))
    # At one place the cut comes first.
    return folded(rows.withColumn("seq", F.col("seq").cast("long")).unionByName(asked).withColumn("later", ~F.col("cut")), FILE, ("global_idx", "later"), Cuts, CHANGES)


def line_kinds(states: DataFrame, kinds: DataFrame) -> DataFrame:
    """(submission_id, path, line, length, last_event, kind, of_kind) of every line: its length with its newline, the latest event in it, the kind
    that most of its characters come from (of ties the first by name) and how many they are.

    Line ends and runs are merged once, in order of their offsets; what stands between two neighbours has one line and one
    origin. states: content and runs; kinds: submission_id, global_idx, kind.
    """
    s = states.select(*FILE, F.split("content", "\n").alias("lines"), "runs")
    lines = s.select(*FILE, F.posexplode("lines").alias("line", "text"), F.size("lines").alias("many"))
    n = utf16_length(F.col("text")) + (F.col("line") < F.col("many") - 1).cast("int")
    lines = lines.withColumn("n", n.cast("long")).withColumn("at", F.sum("n").over(W.partitionBy(*FILE).orderBy("line")) - F.col("n"))
    marks = lines.select(*FILE, "at", F.col("line").cast("long").alias("line"), F.lit(None).cast("long").alias("event_seq"), F.lit(None).cast("long").alias("stop"))
    pieces = s.select(*FILE, F.explode("runs").alias("r")).select(*FILE, F.col("r.offset").cast("long").alias("at"), F.lit(None).cast("long").alias("line"), F.col("r.event_seq").cast("long").alias("event_seq"), (F.col("r.offset") + F.col("r.length")).cast("long").alias("stop"))
    w = W.partitionBy(*FILE).orderBy("at", F.col("event_seq").isNull(), "line")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    m = marks.unionAll(pieces).withColumn("own", F.last("line", True).over(so_far)).withColumn("origin", F.last("event_seq", True).over(so_far)).withColumn("end", F.last("stop", True).over(so_far))
    m = m.withColumn("length", F.least(F.coalesce(F.lead("at").over(w), F.col("end")), F.col("end")) - F.col("at"))
    # A run that begins with a line is before its mark and counts from the mark on.
    m = m.where("length > 0").select(*FILE, F.col("own").alias("line"), F.col("origin").alias("event_seq"), "length")
    known = kinds.select("submission_id", F.col("global_idx").cast("long").alias("event_seq"), "kind")
    by_kind = m.join(known, ["submission_id", "event_seq"], "left").groupBy(*FILE, "line", "kind").agg(F.sum("length").alias("n"), F.max("event_seq").alias("last"))
    found = by_kind.groupBy(*FILE, "line").agg(F.max("last").alias("last_event"), F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"), F.max("n").alias("of_kind"))
    return lines.select(*FILE, F.col("line").cast("long").alias("line"), F.col("n").alias("length")).join(found, [*FILE, "line"], "left")


SAVES = "submission_id long, session_id string, path string, seq long, verdict string"


class Saves:
    """Judges the saves of one file in one session against its replay."""

    def __init__(self, r: dict):
        self.key = {c: r[c] for c in (*SESSION, "path")}
        self.now, self.blind, self.unseen, self.outside, self.recent = Version(), r["shared"], r["shared"], False, None

    def step(self, r: dict) -> list[dict]:
        kind, content = r["kind"], r["content"]
        if kind == "doc.save":
            return [self.key | {"seq": r["seq"], "verdict": self.judged(r["sha256"])}]
        if kind == "fs.external_change":
            self.outside, self.blind, self.recent = True, True, None
        elif kind == "doc.open":
            self.unseen, self.blind = False, content is None
            self.recent = (self.recent or []) if content is not None else None
        elif not self.blind and content is None:
            self.blind, self.recent = True, None
        if not self.blind:
            self.now = self.now.after(r)
            if self.recent is not None:
                self.recent = [*self.recent, self.now.tree][-RECENT:]
        return []

    def judged(self, recorded: str | None) -> str:
        if self.outside:
            self.outside, self.blind, self.now = False, True, Version()
            return "external"
        if self.blind:
            return "unobserved" if self.unseen else "indeterminate"
        if sha256(self.now.text()) == recorded:
            return "match"
        return "late" if any(sha256(rope.text(t)) == recorded for t in reversed((self.recent or [])[:-1])) else "mismatch"

    def finish(self) -> list[dict]:
        return []


def save_verdicts(events: DataFrame) -> DataFrame:
    """verdict of every save (submission_id, session_id, path, seq) by the replay of its file in its session.

    match: the replayed text has the recorded hash. late: one of the 32 states before has it. mismatch: none. external: the
    first save after an outside change. indeterminate: an open without content, a paste without text, or an outside change came
    before. unobserved: the session never saw the file's beginning, and another session has the file too.
    """
    rows = inputs(events)
    many = rows.groupBy(*FILE).agg((F.min("session_id") < F.max("session_id")).alias("shared"))
    return folded(rows.join(many, list(FILE)), (*SESSION, "path"), ("seq",), Saves, SAVES)
