"""How five filters interact: what each order of them keeps, removes and tests in vain.

A text goes once through a finite-state transducer over its UTF-8 bytes, given by two tables: the class of each byte, and
for each state (between words, in a word) and class what is put out: a word begins or ends, a code point, a capital, a
symbol. The state after a byte follows from its class alone, so that all transitions of many texts are looked up together.
The word spans go into an open-addressing hash table, by text and word; a slot's owner is compared byte by byte before a
span counts as the same word, and a span that differs goes on to the next slot.

Filters (a text fails if): A under 100 words; B 100 x distinct words < 80 x words; C 100 x capitals > 10 x code points;
D it holds one of ``#$%&*|``; E it equals a text with a smaller id anywhere in the table, removed or not (texts are compared
by SHA-256). What a document fails is a set of letters; documents are counted by part and set, which is all that orders
of the filters depend on, so the 120 orders cost nothing that grows with the table.

Null text counts as empty and fails A. Null parts count as the empty string. A row without an id equals nothing: it doesn't
fail E and makes no other row fail; rows repeated under one id don't make each other fail. Every row counts. A label row
that repeats counts once; a document is good or toxic if any of its labels says so. Very long texts are slices of their
own; no rows give no parts. Extra columns of any name do no harm: only those asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._jobs import on_workers, staged
from .bpe import slices

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"

#: Classes of bytes; NONE ends a text (the byte 0xFF is never in UTF-8).
BLANK, NEXT, CAPITAL, SYMBOL, OTHER, NONE = range(6)
END_OF_TEXT = b"\xff"
#: What the transducer puts out.
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
#: Bytes up to which words are hashed and compared in steps of eight for all spans at once; longer ones one by one.
SHORT = 64


def classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[32, *range(9, 14)]] = BLANK
    table[128:192] = NEXT
    table[65:91] = CAPITAL
    table[list(SYMBOLS)] = SYMBOL
    table[255] = NONE
    return table


def outputs() -> np.ndarray:
    """By state * 8 + class; state 1 is in a word."""
    table = np.zeros(16, np.uint8)
    for kind in range(6):
        own = (POINT if kind not in (NEXT, NONE) else 0) | (IS_CAPITAL if kind == CAPITAL else 0) | (IS_SYMBOL if kind == SYMBOL else 0)
        inside = kind not in (BLANK, NONE)
        table[kind], table[8 + kind] = own | (BEGINS if inside else 0), own | (0 if inside else ENDS)
    return table


CLASS, OUTPUT = classes(), outputs()
IN_WORD = np.array([0, 8, 8, 8, 8, 0], np.uint8)
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * SPREAD
    return x ^ (x >> np.uint64(29))


class Spans:
    """Word spans of a slice of texts, with their owners, and a hash table over them."""

    def __init__(self, raw: bytes, begin: np.ndarray, end: np.ndarray, text: np.ndarray):
        self.raw, self.begin, self.size, self.text = raw, begin, end - begin, text
        padded = raw + bytes(8)
        self.eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
        self.first = self.lane(np.arange(len(begin)), 0)
        code = mixed(self.first ^ mixed(self.size.astype(np.uint64) + SPREAD * text.astype(np.uint64)))
        for at in range(8, SHORT, 8):
            more = np.flatnonzero((self.size > at) & (self.size <= SHORT))
            if not len(more):
                break
            code[more] = mixed(code[more] ^ self.lane(more, at))
        for i in np.flatnonzero(self.size > SHORT).tolist():
            code[i] ^= np.uint64(hash(self.word(i)) & 0xFFFFFFFFFFFFFFFF)
        self.code = mixed(code)

    def lane(self, which: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes of each word from ``at`` on, zero beyond its end."""
        return self.eight[self.begin[which] + at] & LOW[np.minimum(self.size[which] - at, 8)]

    def word(self, i: int) -> bytes:
        return self.raw[self.begin[i] : self.begin[i] + self.size[i]]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans are the same word of the same text, byte by byte."""
        equal = (self.code[a] == self.code[b]) & (self.text[a] == self.text[b]) & (self.size[a] == self.size[b]) & (self.first[a] == self.first[b])
        for at in range(8, SHORT, 8):
            more = np.flatnonzero(equal & (self.size[a] > at) & (self.size[a] <= SHORT))
            if not len(more):
                break
            equal[more] = self.lane(a[more], at) == self.lane(b[more], at)
        for i in np.flatnonzero(equal & (self.size[a] > SHORT)).tolist():
            equal[i] = self.word(a[i]) == self.word(b[i])
        return equal

    def distinct(self, texts: int) -> np.ndarray:
        """Distinct words of each text: spans that own a slot. All spans are inserted together, slot after slot."""
        bits = max(4, int(2 * len(self.begin)).bit_length())
        mask = np.int64((1 << bits) - 1)
        table = np.full(1 << bits, -1, np.int64)
        slot = (self.code >> np.uint64(64 - bits)).astype(np.int64)
        open_, owners = np.arange(len(self.begin)), []
        while len(open_):
            here = slot[open_]
            free = table[here] < 0
            table[here[free]] = open_[free]
            owner = table[here]
            owners.append(open_[owner == open_])
            rest = np.flatnonzero(owner != open_)
            rest = rest[~self.same(open_[rest], owner[rest])]
            open_ = open_[rest]
            slot[open_] = (slot[open_] + 1) & mask
        return np.bincount(self.text[np.concatenate(owners)], minlength=texts) if owners else np.zeros(texts, np.int64)


def measures(texts_: list[bytes]) -> dict[str, np.ndarray]:
    """words, distinct, points, capitals and symbols of each text."""
    raw = END_OF_TEXT.join(texts_) + END_OF_TEXT
    kind = CLASS[np.frombuffer(raw, np.uint8)]
    state = np.empty(len(kind), np.uint8)
    state[0], state[1:] = 0, IN_WORD[kind[:-1]]
    out = OUTPUT[state | kind]
    sizes = np.fromiter(map(len, texts_), np.int64, len(texts_)) + 1
    first = np.cumsum(sizes) - sizes
    each = lambda bit: np.add.reduceat((out & bit) // bit, first, dtype=np.int64)
    words = each(BEGINS)
    spans = Spans(raw, np.flatnonzero(out & BEGINS), np.flatnonzero(out & ENDS), np.repeat(np.arange(len(texts_)), words))
    return {"words": words, "distinct": spans.distinct(len(texts_)), "points": each(POINT), "capitals": each(IS_CAPITAL), "symbols": each(IS_SYMBOL)}


def failed(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of A to D that each text fails."""
    tests = (m["words"] < MIN_WORDS, 100 * m["distinct"] < DISTINCT_PERCENT * m["words"], 100 * m["capitals"] > CAPITAL_PERCENT * m["points"], m["symbols"] > 0)
    return sum(t.astype(np.int32) << i for i, t in enumerate(tests))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text), words, distinct, points, capitals, symbols, fails (bits of A to D)."""
    on_workers(docs.sparkSession)
    names = ["words", "distinct", "points", "capitals", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                m = measures(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), part.column("digest"), *[pa.array(m[n], pa.int64()) for n in names], pa.array(failed(m), pa.int32())], names=["doc_id", "part", "digest", *names, "fails"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, " + ", ".join(f"{n} long" for n in names) + ", fails int")


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, fails (bits of A to E), good, toxic of every row.

    Texts go to a worker and no further. Rows of some 60 bytes move: once by digest for the smallest id of each repeated
    text, then to that id and to their labels. Both joins are between shuffled tables, so that a text or an id that holds a
    third of all rows is split among tasks.
    """
    facts = staged(measured(docs, id_col, text_col, part_col).select("doc_id", "part", "digest", "fails"), "audit-facts")
    repeated = staged(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "audit-repeated")
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    rows = facts.join(repeated, "digest", "left").select("doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("fails"))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return rows.join(staged(label, "audit-labels"), "doc_id", "left").select("doc_id", "part", "fails", some("quality").alias("good"), some("toxic").alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the bit of the step's filter, bits of the filters before it; for all orders."""
    return [(order, i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:i])) for order in map("".join, permutations(FILTERS)) for i, f in enumerate(order)]


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of that step, one row for each part, order and step."""
    counts = (
        verdicts(docs, labels, id_col, text_col, part_col)
        .groupBy("part", "fails")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    )
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, s, own, before in steps()])
    rows = counts.withColumn("at", F.explode(plan)).select("*", "at.*")
    fails = F.col("fails")
    own, before = fails.bitwiseAND(F.col("own")) > 0, fails.bitwiseAND(F.col("before")) > 0
    # Of the 120 orders, a filter comes first among the k that a document fails in 120 / k.
    turns = F.lit(120) / F.greatest(F.bit_count(fails), F.lit(1))
    total = lambda test, of, name: F.sum(F.when(test, of).otherwise(0)).cast("long").alias(name)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~own & ~before, F.col("n"), "kept"),
        total(own & ~before, F.col("n"), "removed"),
        total(own & before, F.col("n"), "redundant"),
        total(fails == F.col("own"), F.col("n"), "unique_fails"),
        total(own & ~before, F.col("good"), "good_lost"),
        total(own & ~before, F.col("toxic"), "toxic_lost"),
        total(own, F.col("n") * turns.cast("long"), "shapley"),
    )
