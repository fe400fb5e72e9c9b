"""Packing of documents into sequences of a fixed length by minimum bin slack.

A document is its token ids and an end id. Pieces of a whole window are cut off its front and stand alone; what remains is
shorter than a window. How many remainders of each length there are (a row for each length up to the window, however many
documents) is all that the plan depends on. For each window the plan takes the longest remainder that is left and looks
for the multiset of others that comes closest to the capacity: a bitset of reachable sums grows length by length, in powers of
two of how many there are, and the sums before each length are kept, so that counts follow by going back. The pattern is
repeated for as many windows as the counts allow. Where no multiset fills a window, the gap is filled by the beginning of
another remainder, whose rest is a remainder of its own. At last, what is shorter than a window goes into sequences whose
lengths are powers of two. So no sequence needs padding.

The plan says which ranks among the pieces of one length go where. Ranks are counted task by task and added up, so no
task orders all pieces of a length.

Null text counts as empty: such a document is its end id. Rows repeated under one id, or without one, are documents of
their own. Very long texts give many whole windows, one row each. No rows give no pieces. Only the id and the text are
read, so further columns of any name do no harm. Which of equal lengths comes first follows the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._jobs import staged, texts
from .bpe import slices
from .huffman import library_encoder

WINDOW = 2048
#: Bits of a rank in a key of length and rank.
RANK_BITS = 48


def closest(capacity: int, counts: dict[int, int]) -> tuple[int, dict[int, int]]:
    """The largest sum up to capacity, and how many of each length make it; the longest length that fits is one of them."""
    lengths = sorted((n for n, many in counts.items() if many and n <= capacity), reverse=True)
    if not lengths:
        return 0, {}
    first = lengths[0]
    room = capacity - first
    sums, before = 1, []
    for n in lengths:
        many = min(counts[n] - (n == first), room // n)
        if many <= 0:
            continue
        before.append((n, many, sums))
        take = 1
        while many:
            take = min(take, many)
            sums |= sums << take * n
            many -= take
            take *= 2
        sums &= (2 << room) - 1
        if sums >> room & 1:
            break
    left = sums.bit_length() - 1
    total, chosen = first + left, {first: 1}
    for n, many, reached in reversed(before):
        used = next(k for k in range(many + 1) if left >= k * n and reached >> left - k * n & 1)
        if used:
            chosen[n] = chosen.get(n, 0) + used
            left -= used * n
    return total, chosen


@dataclass
class Plan:
    """Where the pieces of each length and rank go; its size depends on the window, not on the number of pieces."""

    #: length << RANK_BITS | first rank; pieces of it in one sequence; first sequence; offset there.
    key: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    #: Tokens that go there; rank that the rest, if any, has among pieces of its length.
    part: list[int] = field(default_factory=list)
    rest: list[int] = field(default_factory=list)

    def put(self, length: int, rank: int, each: int, sequence: int, offset: int, part: int, rest: int = 0) -> None:
        for column, x in zip((self.key, self.each, self.sequence, self.offset, self.part, self.rest), (length << RANK_BITS | rank, each, sequence, offset, part, rest), strict=True):
            column.append(x)

    def arrays(self) -> list[np.ndarray]:
        columns = [np.array(c, np.int64) for c in (self.key, self.each, self.sequence, self.offset, self.part, self.rest)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]


def planned(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """A plan for so many pieces of each length, at most the window."""
    plan, counts = Plan(), dict(histogram)
    used, known = dict.fromkeys(counts, 0), dict(histogram)
    total, sequence = sum(n * many for n, many in counts.items()), 0
    while total:
        capacity = window if total >= window else 1 << total.bit_length() - 1
        filled, chosen = closest(capacity, counts)
        times = min([counts[n] // k for n, k in chosen.items()], default=total // capacity)
        cut = None
        if filled < capacity:
            times_of = {n: many // (chosen.get(n, 0) + 1) for n, many in counts.items() if n > capacity - filled}
            cut = max(times_of, key=lambda n: (times_of[n], n))
            times = min(times, times_of[cut])
        times = min(times, total // capacity) if capacity == window else 1
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            plan.put(n, used[n], k, sequence, offset, n)
            used[n], counts[n], offset = used[n] + times * k, counts[n] - times * k, offset + n * k
        if cut:
            part = capacity - filled
            rest = cut - part
            plan.put(cut, used[cut], 1, sequence, offset, part, known.get(rest, 0))
            used[cut], counts[cut] = used[cut] + times, counts[cut] - times
            used.setdefault(rest, 0)
            known[rest], counts[rest] = known.get(rest, 0) + times, counts.get(rest, 0) + times
        sequence, total = sequence + times, total - times * capacity
    return plan


def placed(length: np.ndarray, rank: np.ndarray, plan: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of pieces given by length and rank: which piece, tokens of it before, length, sequence and offset of every part."""
    key, each, sequence, offset, part, rest = plan
    which, before, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(which):
        at = np.searchsorted(key, length << RANK_BITS | rank, "right") - 1
        i = rank - (key[at] & ((1 << RANK_BITS) - 1))
        out.append((which, before, part[at], sequence[at] + i // each[at], offset[at] + i % each[at] * part[at]))
        more = np.flatnonzero(part[at] < length)
        which, before = which[more], before[more] + part[at][more]
        rank, length = rest[at][more] + i[more], length[more] - part[at][more]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def pieces(docs: DataFrame, path: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids of each document, cut after every whole window; 16-bit ids where they suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        end = np.array([end_id], coder.kind).tobytes()
        size = len(end)
        for batch in batches:
            for part in slices(batch):
                raw = [x.tobytes() + end for x in coder.encode_all(part.column("text").to_pylist())]
                n = np.fromiter(map(len, raw), np.int64, len(raw)) // size
                many = -(-n // window)
                doc = np.repeat(np.arange(len(raw)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * window
                ids = [raw[d][a * size : (a + window) * size] for d, a in zip(doc.tolist(), start.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(np.minimum(n[doc] - start, window)), pa.array(n[doc]), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), size), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "id_bytes"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, id_bytes int")


def packed(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32-bit) of every piece.

    Moved between tasks: a narrow row for each piece, for its rank, and the ids once, to where they go. The driver sees how
    many pieces each length has, a row for each length up to the window, and sends back a plan bounded by the window.
    """
    own = staged(pieces(docs, path, end_id, window, id_col, text_col).withColumn("piece", F.monotonically_increasing_id()), "packing-pieces")
    # The upper bits of the number are the task that wrote the piece.
    narrow = own.select("piece", F.shiftright("piece", 33).alias("task"), "length")
    by_task = staged(narrow.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = planned(histogram, window).arrays()
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = (
        narrow.withColumn("i", F.row_number().over(W.partitionBy("task", "length").orderBy("piece")) - 1)
        .join(by_task.select("task", "length", earlier.alias("earlier")).hint("merge"), ["task", "length"])  # it grows with the tasks
        .select("piece", "length", (F.col("earlier") + F.col("i")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, *columns = placed(batch.column("length").to_numpy(), batch.column("rank").to_numpy(), plan)
            yield pa.RecordBatch.from_arrays([batch.column("piece").take(pa.array(which)), *map(pa.array, columns)], names=["piece", "before", "part", "sequence_id", "offset"])

    places = ranked.mapInArrow(place, "piece long, before long, part long, sequence_id long, offset long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<u2" if size == 2 else "<u4")[b : b + n].astype("<u4").tobytes() for x, size, b, n in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("id_bytes", "before", "part")), strict=True)]
            start = pa.array(batch.column("start").to_numpy() + batch.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), start, *(batch.column(c) for c in ("part", "doc_tokens", "sequence_id", "offset")), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return own.join(places, "piece").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and the pieces (offset, length, doc_id, start) of each sequence, for a trainer's input and
    attention mask. A group is a sequence, so it is bounded by the window."""
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    grouped = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select(
        "sequence_id", (F.length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), F.transform("pieces", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["start"])).alias("pieces")
    )
