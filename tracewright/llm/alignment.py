"""Alignment of two tokenizers: groups of tokens that end at one place, and tokens that overlap.

A is a byte-level BPE file of the tokenizers library, B a model of sentencepiece. Both encode a space and the text, without
special tokens. The ends of both tokenizations, in bytes, are two sorted lists. The shorter one drives: for each of its
ends, the first end of the longer list that isn't before it is found by doubling steps from the last find and a binary
search between them. Equal ends cut both sequences into groups; the ranks found for a token's two ends are the range of
tokens that overlap it.

A text is cut where neither tokenizer has a token across (an end in both), so each distinct unit of text is aligned once
and a document is the sum of its units. Documents of a few megabytes are a block. A block names each id pair that its
documents link once, with how many of them do; these rows are added up over the corpus, and each block gets back the counts
of its own pairs. So no document's links move, and no task needs all pairs.

A document whose text is null or empty, or whose joined token bytes differ from the space and the text in either tokenizer,
has no tokens: counts of zero and an empty string. Rows repeated under one id, or without an id, are documents of their own
and count as such. Pairs that tie for an A id's highest count are all best. A very long text is a block of its own. No rows
give no rows. Only the id and the text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import functools
import hashlib
import os
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._jobs import staged, texts
from .bpe import Remembered, byte_characters, slices, units

#: Bytes of text of a block, about; units that a worker remembers in each generation.
BLOCK = 6 << 20
REMEMBERED = 60_000
LOW = (1 << 32) - 1

BLOCK_SCHEMA = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, ends array<long>, pairs binary, times binary, keys binary, docs binary"


def gallop(ends: list[int], target: int, at: int) -> int:
    """The first place from ``at`` on whose end isn't before target."""
    step = 1
    while at + step < len(ends) and ends[at + step] < target:
        at += step
        step *= 2
    return bisect_left(ends, target, at, min(at + step + 1, len(ends)))


def intersected(few: list[int], many: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of two lists of ends, the shorter one first: places (in few, in many) of equal ends, and for each token of the first
    the first and the last token of the second that overlap it."""
    common, ranges, at, first = [], [], 0, 0
    for i, end in enumerate(few):
        at = gallop(many, end, at)
        ranges.append((first, at))
        first = at
        if many[at] == end:
            common.append((i, at))
            first = at + 1
    return common, ranges


class Aligner:
    """Both tokenizers of a worker, and what they gave for units of text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation(), self.a.no_padding()
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_characters().items()}
        self.bytes_a = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        names = self.b.id_to_piece(list(range(size)))
        self.bytes_b = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        #: Whether B may have a token end between two bytes wherever they meet: no piece has them side by side.
        self.apart = np.ones((256, 256), bool)
        for i, x in enumerate(self.bytes_b):
            if not self.b.is_byte(i):
                self.apart[list(x[:-1]), list(x[1:])] = False
        #: Then a newline before a unit keeps the model from putting its own space there.
        self.by_newline = bool(self.apart[10].all() and self.apart[:, 10].all() and self.b.encode("\nx", out_type=str)[:2] == ["▁", "<0x0A>"])
        self.known = Remembered(self.made, REMEMBERED)

    def units(self, raw: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts, and how many each has: those of A's pattern, joined where B may have a token across."""
        array, counts = units(raw)
        ends = np.frombuffer(array.buffers()[1], np.int32)[: len(array) + 1]
        data = np.frombuffer(array.buffers()[2], np.uint8)
        first = np.zeros(len(array), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        at = ends[:-1]
        keep = first | (self.apart[data[np.maximum(at, 1) - 1], data[at]] & ((data[at] == 32) | self.by_newline))
        owner = np.repeat(np.arange(len(raw)), counts)
        return pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(np.r_[at[keep], len(data)].astype(np.int32)), array.buffers()[2]]), np.bincount(owner[keep], minlength=len(raw))

    def encoded_b(self, asked: list[bytes]) -> list[list[int]]:
        """Units begin with the space that the model puts before a text, or a newline takes its place."""
        led = [x[:1] == b" " and (len(x) > 1 or not self.by_newline) for x in asked]
        ids = self.b.encode([x[1:].decode() if s else "\n" + x.decode() for x, s in zip(asked, led, strict=True)], num_threads=1)
        return [x if s else x[2:] for x, s in zip(ids, led, strict=True)]

    def made(self, asked: list[bytes]) -> list[tuple]:
        """Of each unit: whether both tokenizers keep its bytes; tokens of A and B, groups; the groups; linked pairs as a << 32 | b."""
        out = []
        for unit, a, b in zip(asked, (e.ids for e in self.a.encode_batch_fast([x.decode() for x in asked], add_special_tokens=False)), self.encoded_b(asked), strict=True):
            parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if b"".join(parts_a) != unit or b"".join(parts_b) != unit:
                out.append((False, 0, 0, 0, "", b""))
                continue
            ends_a, ends_b = np.cumsum([len(x) for x in parts_a]).tolist(), np.cumsum([len(x) for x in parts_b]).tolist()
            turned = len(ends_b) < len(ends_a)
            common, ranges = intersected(ends_b, ends_a) if turned else intersected(ends_a, ends_b)
            text, i, j = [], 0, 0
            for x, y in common:
                x, y = (y, x) if turned else (x, y)
                text.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
                i, j = x + 1, y + 1
            links = [(a[y] << 32 | b[x]) if turned else (a[x] << 32 | b[y]) for x, (lo, hi) in enumerate(ranges) for y in range(lo, hi + 1)]
            out.append((True, len(a), len(b), len(common), ";".join(text), np.array(links, np.int64).tobytes()))
        return out

    def block(self, texts_: list[str | None]) -> dict:
        """Figures of each text, and of all texts together the distinct pairs and who links them how often."""
        raw = [b" " + t.encode() if t else b"" for t in texts_]
        array, counts = self.units(raw)
        coded = array.dictionary_encode()
        found = self.known(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        doc = np.repeat(np.arange(len(raw)), counts)
        fine = np.fromiter((x[0] for x in found), bool, len(found))
        good = np.bincount(doc[~fine[which]], minlength=len(raw)) == 0
        total = lambda x: np.where(good, np.bincount(doc, x[which], len(raw)), 0).astype(np.int64)
        links = [np.frombuffer(x[5], np.int64) for x in found]
        n = np.fromiter(map(len, links), np.int64, len(links))
        figures = [np.fromiter((x[k] for x in found), np.int64, len(found)) for k in (1, 2, 3)]
        strings, ends, at = [x[4] for x in found], np.cumsum(counts).tolist(), which.tolist()
        groups = [";".join([strings[i] for i in at[e - c : e]]) if c and ok else None for e, c, ok in zip(ends, counts.tolist(), good.tolist(), strict=True)]
        # Distinct units of each document, then the pairs of those units.
        unit, often = np.unique(np.where(good[doc], doc * len(found) + which, -1), return_counts=True)
        unit, often = (unit[1:], often[1:]) if len(unit) and unit[0] < 0 else (unit, often)
        owner, unit = np.divmod(unit, max(len(found), 1))
        keys, own = np.unique(np.concatenate(links) if links else np.zeros(0, np.int64), return_inverse=True)
        many = n[unit]
        place = np.repeat((np.cumsum(n) - n)[unit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        entry, back = np.unique(np.repeat(owner, many) * max(len(keys), 1) + own[place], return_inverse=True)
        times = np.bincount(back, np.repeat(often, many), len(entry)).astype(np.int64)
        owner, pair = np.divmod(entry, max(len(keys), 1))
        linked = np.bincount(pair, minlength=len(keys))
        used = np.flatnonzero(linked)
        return {"figures": [*map(total, figures), total(n)], "groups": groups, "ends": np.cumsum(np.bincount(owner, minlength=len(raw))), "pairs": (np.cumsum(linked > 0) - 1)[pair], "times": times, "keys": keys[used], "docs": linked[used]}


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of BLOCK_SCHEMA: lists over the block's documents, entries of 32 bits over the links of each, distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, BLOCK):
                found = both.block(part.column("text").to_pylist())
                sha = [hashlib.sha256(g.encode()).hexdigest() if g is not None else "" for g in found["groups"]]
                lists = [part.column("doc_id").to_pylist(), *found["figures"], sha, found["ends"]]
                raw = [found["pairs"].astype("<u4"), found["times"].astype("<u4"), found["keys"].astype("<i8"), found["docs"].astype("<u4")]
                kinds = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string()), pa.list_(pa.int64())] + [pa.binary()] * 4
                columns = [pa.array([x], k) for x, k in zip([*lists, *(x.tobytes() for x in raw)], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, BLOCK_SCHEMA)


def named(own: DataFrame) -> DataFrame:
    """block, place, a, b, docs: each distinct pair of a block and how many of its documents link it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, docs in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "docs")), strict=True):
                keys, docs = np.frombuffer(keys, "<i8"), np.frombuffer(docs, "<u4")
                columns = [np.full(len(keys), block, np.int64), np.arange(len(keys), dtype=np.int32), (keys >> 32).astype(np.int32), (keys & LOW).astype(np.int32), docs.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "place", "a", "b", "docs"])

    return own.select("block", "keys", "docs").mapInArrow(run, "block long, place int, a int, b int, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, documents, best (the count is the highest of any pair with this a): the corpus-wide table of linked ids."""
    counts = staged(pairs.groupBy("a", "b").agg(F.sum("docs").alias("documents")), "alignment-counts")
    # A row for each id of A's vocabulary at most.
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Moved between tasks: the distinct pairs of each block, three numbers a pair; their counts back; the blocks once.
    """
    own = staged(blocks(docs, path_a, path_b, id_col, text_col).withColumn("block", F.monotonically_increasing_id()), "alignment-blocks")
    pairs = named(own)
    back = pairs.join(pair_counts(pairs), ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("place", "documents", "best")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = batch.column("known")[i]
                size = len(known) if known.is_valid else 0
                count, best = np.zeros(size, np.int64), np.zeros(size, bool)
                if size:
                    place = known.values.field("place").to_numpy()
                    count[place], best[place] = known.values.field("documents").to_numpy(), known.values.field("best").to_numpy(zero_copy_only=False)
                pair, times = (np.frombuffer(batch.column(c)[i].as_py(), "<u4") for c in ("pairs", "times"))
                ends = np.r_[0, batch.column("ends")[i].values.to_numpy()]
                summed = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])  # noqa: E731, B023
                figures = [summed(times * best[pair]), summed(times * count[pair])]
                lists = [batch.column(c)[i].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha")]
                yield pa.RecordBatch.from_arrays([*lists[:5], *(pa.array(x.astype(np.int64)) for x in figures), lists[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = own.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "ends", "pairs", "times").join(back, "block", "left")
    return joined.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus-wide table alone: a, b, documents, best."""
    return pair_counts(named(staged(blocks(docs, path_a, path_b, id_col, text_col).withColumn("block", F.monotonically_increasing_id()), "alignment-blocks")))
