"""Token ids in files of canonical length-limited Huffman codes.

The texts are encoded once and their ids staged, with each task's counts of them. Global counts of the ids give code lengths by package-merge, at most
LIMIT bits, and canonical codes, so that the codebook is one length for each id. Each document's ids become a run of bits,
padded to bytes; documents go to ranges of doc_id, are sorted there and joined to blocks. A block is one row of the file:

    part, block   its place: ascending doc_id over (part, block)
    first_token   tokens of the part before the block
    doc_ids, n_tokens, tails   one entry for each document; tails tells documents of one id apart
    checkpoints   bit offset of every STEP-th token of every document, in order
    payload       the bits

Blocks don't depend on each other. Reading goes through all runs between checkpoints of a block at once: a table with
2**LIMIT entries gives the token and the length of the code that starts at a bit.

Null text counts as empty: such a document holds the end id only. A very long text is a block of its own; no rows give files
without blocks, which read back as no rows. Rows without a doc_id come first; rows that share a
doc_id are ordered by their text's hash, and every one is written.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._jobs import discard, new_path, staged, texts
from .bpe import SPACES, Remembered, by_units, slices

LIMIT = 20
STEP = 128
#: Tokens of a block at least, but for a part's last; a block ends with a document.
BLOCK = 1 << 18
#: Tokens of a part, about.
PART = 1 << 22

#: Units of each generation that a worker remembers, and units that the library takes at once; they bound memory only.
REMEMBERED = 300_000
AT_ONCE = 20_000
#: First bytes of white space, of one byte and of more.
BLANK, LEADS = ({c.encode()[0] for c in SPACES if (len(c.encode()) > 1) == more} for more in (False, True))

TOKENS = "doc_id long, tail long, ids binary, wide boolean, counts array<struct<id: long, n: long>>"
COUNTS = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
#: Bytes of ids whose codes are put together at once.
PACKED = 1 << 18

BLOCK_SCHEMA = "part int, block int, first_token long, doc_ids array<long>, n_tokens array<long>, tails array<long>, checkpoints array<long>, payload binary"


class LibraryEncoder:
    """The tokenizers library with bounded memory of what it gave for units of text (see bpe.units): distinct units that are
    not known go through it many at once, a newline between them. A file whose texts aren't cut by the byte-level pattern
    alone gets whole texts through the library, and so do texts with special strings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        self.kind = "<u4" if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16 else "<u2"
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_units = spec.get("normalizer") is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        self.newline = self.whole("\n") if self.by_units else b""
        self.plain = regex.compile(f" ?[^{SPACES}]+").fullmatch
        self.known = Remembered(self.made, REMEMBERED)

    def whole(self, text: str | None) -> np.ndarray:
        return np.array(self.library.encode(text or "", add_special_tokens=False).ids, self.kind)

    def simple(self, unit: bytes) -> bool:
        """One blank at most, then visible characters."""
        lead = unit[0] == 32
        if len(unit) == lead or unit[lead] in BLANK:
            return False
        return unit[lead] not in LEADS or self.plain(unit.decode()) is not None

    def made(self, asked: list[bytes]) -> list[bytes]:
        """Ids of units: simple ones together, since a newline between two is a piece of its own."""
        together = list(map(self.simple, asked)) if len(self.newline) == 1 else [False] * len(asked)
        out = [b"" if ours else self.whole(unit.decode()).tobytes() for unit, ours in zip(asked, together, strict=True)]
        order = [i for i, ours in enumerate(together) if ours]
        for at in range(0, len(order), AT_ONCE):
            mine = order[at : at + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([b"\n".join([asked[i] for i in mine]).decode()], add_special_tokens=False)[0].ids, self.kind)
            raw, size = ids.tobytes(), ids.itemsize
            ends = (np.flatnonzero(ids == self.newline[0]) * size).tolist()
            for i, a, b in zip(mine, [0, *[e + size for e in ends]], [*ends, len(raw)], strict=True):
                out[i] = raw[a:b]
        return out

    def encode_all(self, texts_: list[str | None]) -> list[np.ndarray]:
        whole = {i: self.whole(t) for i, t in enumerate(texts_) if not self.by_units or (t and any(a in t for a in self.added))}
        found = by_units([b"" if i in whole else (t or "").encode() for i, t in enumerate(texts_)], self.known, self.kind)
        return [whole.get(i, ids) for i, ids in enumerate(found)]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """TOKENS: doc_id, tail (hash of the text), ids: 16-bit where the vocabulary allows, each document's end id included. A
    task's last row has counts only: how often each id stands in what the task gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        end = np.array([end_id], coder.kind).tobytes()
        total = np.zeros(0, np.int64)

        def rows(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tail", "ids", "wide", "counts"])

        for batch in batches:
            for part in slices(batch):
                ids = [x.tobytes() + end for x in coder.encode_all(part.column("text").to_pylist())]
                n = np.bincount(np.frombuffer(b"".join(ids), coder.kind), minlength=len(total))
                n[: len(total)] += total
                total = n
                yield rows([part.column("doc_id"), part.column("tail"), pa.array(ids, pa.binary()), pa.array([coder.kind == "<u4"] * len(ids)), pa.nulls(len(ids), COUNTS)])
        found = np.flatnonzero(total)
        if len(found):
            pairs = pa.StructArray.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])
            yield rows([pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.bool_())] + [pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pairs)])

    return texts(docs).select("doc_id", F.xxhash64("text").alias("tail"), "text").mapInArrow(run, TOKENS)


def counted(tokens: DataFrame) -> DataFrame:
    """id, n over all documents, from the tasks' counts: at most one row for each id and task."""
    return tokens.where("counts is not null").select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most limit bits, by package-merge: a symbol's length is how often it is among the
    2n - 2 cheapest items of the last list, where each list pairs up the list before and adds all symbols anew."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n <= 1:
        return dict.fromkeys(symbols, 1)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    weight = np.array([counts[s] for s in symbols], np.int64)
    # Of each list only the order matters: which of its items are symbols; packages take the rest in order.
    packed, is_symbol = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([weight, packed])
        order = np.argsort(both, kind="stable")
        is_symbol.append(order < n)
        both = both[order]
        packed = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for mine in reversed(is_symbol):
        chosen = int(mine[:take].sum())
        length[:chosen] += 1
        take = 2 * (take - chosen)
    return dict(zip(symbols, length.tolist(), strict=True))


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths by id: codes count up in order of (length, id)."""
    ids, n = in_order(lengths)
    code, length = np.zeros(max(lengths, default=0) + 1, np.uint64), np.zeros(max(lengths, default=0) + 1, np.int64)
    room = max(lengths.values(), default=0) - n
    code[ids], length[ids] = np.cumsum(1 << room) - (1 << room) >> room, n
    return code, length


def in_order(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths in order of (length, id)."""
    ids, n = (np.fromiter(x, np.int64, len(lengths)) for x in (lengths.keys(), lengths.values()))
    order = np.lexsort((ids, n))
    return ids[order], n[order]


def pack(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of the codes of documents of so many ids each, highest first, each document padded to bytes; the byte at
    which each starts, with the end; and every id's bit offset within its document."""
    n = length[ids]
    ends = np.cumsum(n)
    last = np.cumsum(counts)
    bits = np.diff(np.r_[0, ends[last - 1]]) if len(counts) else np.zeros(0, np.int64)
    bytes_ = np.r_[0, np.cumsum(bits + 7 >> 3)]
    own = ends - n - np.repeat(np.cumsum(bits) - bits, counts)
    at = own + 8 * np.repeat(bytes_[:-1], counts)
    word, room = at >> 6, 64 - (at & 63) - n
    value = code[ids]
    over = np.flatnonzero(room < 0)
    low = value << np.maximum(room, 0).astype(np.uint64)
    low[over] = value[over] >> (-room[over]).astype(np.uint64)
    out = np.zeros((int(bytes_[-1]) + 7 >> 3) + 1, np.uint64)
    if len(ids):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[starts]] = np.bitwise_or.reduceat(low, starts)
        out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(bytes_[-1])], bytes_, own


def unpack(payload: bytes, checkpoints: np.ndarray, runs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Token ids of all runs: runs[i] tokens from bit checkpoints[i]. All runs advance together, the longest first."""
    order = np.argsort(-runs, kind="stable")
    at, left = checkpoints[order].astype(np.int64), runs[order]
    ends = np.cumsum(runs)
    to = (ends - runs)[order]
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    wide = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, "<u4")
    falling = -left
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(falling, -step, "left"))
        here = at[:live]
        entry = table[(wide[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)]
        out[to[:live] + step] = entry >> 5
        here += entry & 31
    return out


def decoding_table(lengths: dict[int, int]) -> np.ndarray:
    """2**LIMIT entries id << 5 | length: canonical codes take them up from the first on, in order of (length, id)."""
    ids, n = in_order(lengths)
    table = np.zeros(1 << LIMIT, np.uint32)
    entries = np.repeat((ids << 5 | n).astype(np.uint32), 1 << LIMIT - n)
    table[: len(entries)] = entries
    return table


def write(docs: DataFrame, tokenizer_path: str, to: str, end_id: int = 2) -> None:
    """Files under ``to``: blocks/ and codebook/ (id, length).

    Moved between tasks: the coded documents, once. The driver sees the counts (a row for each id of the vocabulary) and
    the bounds of the parts.
    """
    spark = docs.sparkSession
    made = staged(tokenised(docs, tokenizer_path, end_id), "huffman-ids")
    counts = {r["id"]: r["n"] for r in counted(made).collect()}
    tokens = made.where("counts is null").drop("counts")
    lengths = code_lengths(counts)
    spark.createDataFrame(sorted(lengths.items()), "id long, length int").coalesce(1).write.parquet(f"{to}/codebook")
    parts = max(1, -(-sum(counts.values()) // PART))
    bounds = tokens.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).head()[0] if parts > 1 else []

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = canonical(lengths)
        for batch in batches:
            for part in slices(batch, PACKED, "ids"):
                docs = [np.frombuffer(x.as_buffer(), "<u4" if wide else "<u2") for x, wide in zip(part.column("ids"), part.column("wide").to_pylist(), strict=True)]
                counts = np.array([len(d) for d in docs])
                payload, at, offset = pack(np.concatenate(docs), counts, code, length)
                bits = [payload[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                ends = np.cumsum(counts)
                marks = [offset[e - k : e : STEP] for e, k in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tail"), pa.array(counts, pa.int64()), pa.array(bits, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                    names=["doc_id", "tail", "n_tokens", "bits", "offsets"],
                )

    bits = tokens.mapInArrow(coded, "doc_id long, tail long, n_tokens long, bits binary, offsets array<long>")
    limits = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds or []))]).cast("array<long>")
    ranged = bits.withColumn("part", F.coalesce(F.size(F.filter(limits, lambda b: b <= F.col("doc_id"))), F.lit(0)))
    (
        ranged.repartition(parts, "part")
        .sortWithinPartitions("part", "doc_id", "tail")
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.parquet(f"{to}/blocks")
    )
    discard(made)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK_SCHEMA from documents in order of (part, doc_id)."""
    part = block = first = n = bits = 0
    docs: list[tuple] = []

    def row() -> pa.RecordBatch:
        ids, tails, tokens, payload, offsets = zip(*docs, strict=True)
        values = [part, block, first, ids, tokens, tails, np.concatenate(offsets), b"".join(payload)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "doc_id", "tail", "n_tokens")]
        for i, (own, doc_id, tail, tokens) in enumerate(zip(*columns, strict=True)):
            if docs and (own != part or n >= BLOCK):
                yield row()
                block, first = (block + 1, first + n) if own == part else (0, 0)
                docs, n, bits = [], 0, 0
            part = own
            payload = batch.column("bits")[i].as_py()
            docs.append((doc_id, tail, tokens, payload, batch.column("offsets")[i].values.to_numpy() + bits))
            n, bits = n + tokens, bits + 8 * len(payload)
    if docs:
        yield row()


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian 32-bit) from the files."""
    lengths = {r["id"]: r["length"] for r in spark.read.schema("id long, length int").parquet(f"{at}/codebook").collect()}
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(f"{at}/blocks")
    ends = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    before, base = 0, {}
    for part in sorted(ends):
        base[part], before = before, before + ends[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n_tokens")[i].values.to_numpy()
                per_doc = -(-n // STEP)
                runs = np.full(int(per_doc.sum()), STEP)
                runs[np.cumsum(per_doc) - 1] = n - (per_doc - 1) * STEP
                ids = unpack(batch.column("payload")[i].as_py(), batch.column("checkpoints")[i].values.to_numpy(), runs, table)
                ends = np.cumsum(n)
                start = base[batch.column("part")[i].as_py()] + batch.column("first_token")[i].as_py() + ends - n
                offsets = pa.array(np.r_[0, ends] * 4).cast(pa.int32())  # an error beyond 2 GB, which no row holds either
                out = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), out], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder and reads them."""
    to = new_path(docs.sparkSession, "huffman")
    write(docs, tokenizer_path, to, end_id)
    return read(docs.sparkSession, to)
