"""Pastes that move a person's own text: their lines stand in a file at that moment (copy), or were deleted before (cut).

Lines are trimmed and blank ones left out. A paste matches a text if the text has a run of lines that begins with the paste's
first line and goes on with at least a share of its lines. Runs are found by hashes of windows of 1, 2, 4, ... lines: the hash of the
first window of a paste, the largest within the share, is an equal key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from ..functions import rope
from ..plans.staging import staged
from .contents import FILE, from_units
from .versions import Version, folded, inputs

#: Share of lines that has to match, share of the person's own characters, characters of a paste or a deletion at least.
MATCH, OWN, LEAST = 0.95, 0.9, 40
#: What is trimmed from lines.
BLANK = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def trimmed_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    return F.filter(lines, lambda x: x != "")


def windows(lines: np.ndarray, level: int) -> np.ndarray:
    """Hashes of all windows of 2 ** level lines, from hashes of lines; each doubling puts two neighbours together."""
    h = lines.astype(np.uint64)
    for p in range(level):
        k = 1 << p
        h = (h[:-k] ^ (h[:-k] >> np.uint64(29))) * SPREAD + h[k:] if len(h) > k else h[:0]
    return h.astype(np.int64)


KEYS = "submission_id long, place long, ord int, lines array<string>, required int, level int, distance int, first long, last long"


def needle_keys(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each needle the first and the last of the largest windows within its required beginning; together they cover it."""
    fields = to_arrow_schema(StructType.fromDDL(KEYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                required = math.ceil(len(r["lines"]) * share)
                level = required.bit_length() - 1
                h = windows(np.array([hashed(x) for x in r["lines"][:required]], np.int64), level)
                out.append(r | {"required": required, "level": level, "distance": len(h) - 1, "first": int(h[0]), "last": int(h[-1])})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return run


def hay_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """submission_id, source_place, level, i, hash of the windows of one level."""
    for batch in batches:
        for submission, place, level, lines in zip(*(batch.column(c).to_pylist() for c in ("submission_id", "source_place", "level", "lines")), strict=True):
            h = windows(np.array([hashed(x) for x in lines], np.int64), level)
            same = [pa.array(np.full(len(h), x, np.int64)) for x in (submission, place)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(h), level, np.int32)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], names=["submission_id", "source_place", "level", "i", "hash"])


@F.pandas_udf(IntegerType())
def _anchored_run(needle: pd.Series, hay: pd.Series) -> pd.Series:
    def longest(a: list[str], b: list[str]) -> int:
        best = 0
        for i in range(len(b)):
            n = 0
            while n < len(a) and i + n < len(b) and a[n] == b[i + n]:
                n += 1
            best = max(best, n)
        return best

    return pd.Series([longest(list(a), list(b)) for a, b in zip(needle, hay, strict=True)])


def anchored(needles: DataFrame, hays: DataFrame, share: float = MATCH) -> DataFrame:
    """(submission_id, place, ord, source_place, run, lines): of each text (submission_id, place, ord, content) the earliest own text
    (submission_id, place, content) before it that it matches, and how many lines do.

    Equal texts count once, and of the texts that share a beginning only the earliest goes on, so that a license that many hold
    makes no pairs of them. Whole lines are fetched for one pair a needle.
    """
    n = needles.select(F.col("submission_id").cast("long"), F.col("place").cast("long"), F.col("ord").cast("int"), trimmed_lines(F.col("content")).alias("lines")).where(F.size("lines") > 0)
    n = staged(n.mapInArrow(needle_keys(share), KEYS), "move-needles")
    key = ["submission_id", "level", "distance", "first", "last"]
    kinds = n.select(*key).distinct()

    h = hays.select(F.col("submission_id").cast("long"), F.col("place").cast("long").alias("source_place"), trimmed_lines(F.col("content")).alias("lines")).where(F.size("lines") > 0)
    h = h.withColumn("text", F.xxhash64("lines")).groupBy("submission_id", "text").agg(F.min_by("lines", "source_place").alias("lines"), F.min("source_place").alias("source_place"))
    asked = h.join(kinds.select("submission_id", "level").distinct(), "submission_id").where(F.size("lines") >= F.pow(F.lit(2), F.col("level")))
    w = asked.select("submission_id", "source_place", "level", "lines").mapInArrow(hay_windows, "submission_id long, source_place long, level int, i int, hash long")
    held = staged(w.join(kinds.select("submission_id", "level", F.col("first").alias("hash")).unionAll(kinds.select("submission_id", "level", "last")).distinct(), ["submission_id", "level", "hash"], "left_semi"), "move-windows")
    begin = held.withColumnRenamed("hash", "first").join(kinds, ["submission_id", "level", "first"])
    end = held.select("submission_id", "source_place", "level", F.col("i").alias("j"), F.col("hash").alias("last"))
    hit = begin.withColumn("j", F.col("i") + F.col("distance")).join(end, ["submission_id", "source_place", "level", "j", "last"])
    earliest = hit.groupBy(*key).agg(F.min("source_place").alias("source_place"))
    found = n.join(earliest, key).where("source_place < place")
    whole = found.join(h.select("submission_id", "source_place", F.col("lines").alias("hay")), ["submission_id", "source_place"])
    run = whole.withColumn("run", _anchored_run("lines", "hay")).where("run >= required")
    return run.groupBy("submission_id", "place", "ord").agg(F.min("source_place").alias("source_place"), F.max_by("run", -F.col("source_place")).alias("run"), F.first(F.size("lines")).alias("lines"))


def hashed(line: str) -> int:
    """As Spark's xxhash64 of the line."""
    n = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42)
    return n - (1 << 64) if n >> 63 else n


FOUND = "submission_id long, path string, kind string, place long, ord int, run int, lines int, typed double, content string, own boolean"


class Moves:
    """Looks up the pastes of the submission in one file as it is then, and gives what is deleted from it."""

    def __init__(self, r: dict):
        self.file, self.now, self.foreign = {c: r[c] for c in FILE}, Version(), set()
        self.known: tuple | None = None

    def lines(self) -> tuple[list[int], list[tuple[int, int]], dict[int, list[int]]]:
        """Hashes of the file's lines, where each begins and ends, and places of each hash."""
        if self.known is None or self.known[0] is not self.now.tree:
            hashes, spans, places, at = [], [], {}, 0
            for raw in self.now.text().split("\n"):
                line = raw.strip(BLANK)
                if line:
                    lead = len(raw) - len(raw.lstrip(BLANK))
                    h = hashed(from_units(line))
                    places.setdefault(h, []).append(len(hashes))
                    hashes.append(h)
                    spans.append((at + lead, at + lead + len(line)))
                at += len(raw) + 1
            self.known = (self.now.tree, hashes, spans, places)
        return self.known[1:]

    def own_share(self, start: int, stop: int) -> float:
        if stop <= start:
            return 0.0
        return sum(len(t) for t, o in rope.pieces(rope.part(self.now.tree, start, stop)) if o not in self.foreign) / (stop - start)

    def looked_up(self, r: dict) -> list[dict]:
        needle, required = r["needle"], math.ceil(len(r["needle"]) * r["share"])
        hashes, spans, places = self.lines()
        best, at = 0, 0
        for i in places.get(needle[0], ()):
            n = 1
            while n < len(needle) and i + n < len(hashes) and hashes[i + n] == needle[n]:
                n += 1
            if n > best:
                best, at = n, i
        if best < max(required, 1):
            return []
        typed = self.own_share(spans[at][0], spans[at + best - 1][1])
        return [self.file | {"kind": "copy", "place": r["global_idx"], "ord": r["ord"], "run": best, "lines": len(needle), "typed": typed}] if typed >= r["least_own"] else []

    def step(self, r: dict) -> list[dict]:
        if r["needle"] is not None:
            return self.looked_up(r)
        out = []
        if r["kind"] in ("doc.change", "paste") and r["start_line"] is not None and r["end_line"] is not None:
            if r["end_line"] - r["start_line"] >= 1 or r["end_char"] - r["start_char"] >= r["least"]:
                start, stop = rope.place(self.now.tree, r["start_line"], r["start_char"]), rope.place(self.now.tree, r["end_line"], r["end_char"])
                if stop - start >= r["least"]:
                    gone = rope.text(rope.part(self.now.tree, start, stop))
                    out = [self.file | {"kind": "cut", "place": r["global_idx"], "content": from_units(gone), "own": self.own_share(start, stop) >= r["least_own"]}]
        if r["kind"] in ("paste", "fs.external_change") or r["pasted"]:
            self.foreign.add(r["global_idx"])
        self.now = self.now.after(r)
        return out

    def finish(self) -> list[dict]:
        return []


def internal_moves(events: DataFrame, candidates: DataFrame, share: float = MATCH, own: float = OWN, least: int = LEAST) -> DataFrame:
    """(submission_id, place, ord, move, path, source_place, run, lines, typed) of the pastes that move own text.

    events: content events as for ``versions.file_states``; ``pasted`` marks changes that a paste made. candidates: submission_id, place (global_idx),
    ord, content. A paste goes as hashes of its lines to each file of its submission, which is replayed up to it. Where several
    files hold it, the first by name counts; a copy goes before a cut, the earliest own deletion before later ones. What a file
    gives up is never forgotten.
    """
    pasted = F.coalesce(F.col("pasted"), F.lit(False)) if "pasted" in events.columns else F.lit(False)
    rows = inputs(events.withColumn("pasted", pasted), "pasted").withColumn("seq", F.col("seq").cast("long"))
    long = candidates.where(F.length("content") >= least).select("submission_id", "place", F.col("ord").cast("int").alias("ord"), "content")
    needles = long.select("submission_id", F.col("place").cast("long").alias("global_idx"), "ord", F.transform(trimmed_lines(F.col("content")), lambda x: F.xxhash64(x)).alias("needle")).where(F.size("needle") > 0)
    asked = rows.select(*FILE).distinct().join(needles, "submission_id")
    more = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in asked.columns}
    both = rows.withColumn("ord", F.lit(None).cast("int")).withColumn("needle", F.lit(None).cast("array<bigint>")).unionByName(asked.select("*", *more.values()))
    both = both.withColumns({"share": F.lit(float(share)), "least_own": F.lit(float(own)), "least": F.lit(least), "later": F.col("needle").isNull()})
    found = folded(both, FILE, ("global_idx", "later", "ord"), Moves, FOUND)
    copies = found.where("kind = 'copy'").groupBy("submission_id", "place", "ord").agg(F.min(F.struct("path", "run", "lines", "typed")).alias("f"))
    copies = copies.select("submission_id", "place", "ord", F.lit("copy").alias("move"), "f.path", F.col("place").alias("source_place"), "f.run", "f.lines", "f.typed")
    gone = found.where("kind = 'cut' and own").select("submission_id", "place", "path", "content")
    left = long.join(copies.select("submission_id", "place", "ord"), ["submission_id", "place", "ord"], "left_anti")
    cuts = anchored(left, gone, share).join(gone.select("submission_id", F.col("place").alias("source_place"), "path"), ["submission_id", "source_place"])
    return copies.unionByName(cuts.select("submission_id", "place", "ord", F.lit("cut").alias("move"), "path", "source_place", "run", "lines", F.lit(1.0).alias("typed")))
