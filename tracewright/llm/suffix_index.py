"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Every string of LENGTH bytes has an anchor: the leftmost of its GRAM-byte strings with the smallest hash. Equal strings
have their anchors at equal places, so an array needs only the suffixes that start at an anchor, about one in 185; the
strings with one anchor are its stretch. A suffix is held by its first GRAM bytes, which all strings of its stretch share.

Texts come in batches of SLOT_BYTES for each task slot of the session. A batch gets its suffix array: anchored suffixes
dealt to buckets and in order of bytes. It is merge-scanned against itself and against every level of the family for
suffixes that more than one place has (sort-merge joins of tables with the same buckets: nothing moves), then enters level
0. FAN arrays of one level are merged into one of the next, so an array on level i holds FAN**i batches and an entry is
written again at most log(batches) times, to the base FAN.

Stretches of one suffix are then looked at byte by byte: those that are equal as a whole are repeated, known by a 128-bit
digest; the others' bytes go to one task. There a hash of LENGTH bytes nominates pairs of strings whose bytes are compared;
where a pair differs, all strings are sorted by doubling ranks, a suffix array in which equal neighbours (a common prefix of
LENGTH) are repeated. A suffix whose stretches hold more than GROUP_BYTES is split: its strings become rows, counted by
digest, so that no task has to hold them. Both kinds are read from the texts in one pass and dealt in one shuffle.

Passages of WORDS words, white space apart, that another text has too are found on the same way: anchors are the smallest of
the hashes of WORD_GRAM words, and such a suffix is held by that hash (8 bytes, so that no suffix of bytes equals it). They
may be shorter than LENGTH and remove nothing; a text that has one is marked by a span at PASSAGE.

    null or short text    nothing to remove
    texts that stand more than once   all their bytes are repeated; their other strings take part once
    very long texts       are cut into overlapping chunks for the array, so a task holds a text and a chunk's tables
    repeated ids          every input row gives a row; equal text in two rows is in two places
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._jobs import delete, discard, new_path, staged, texts
from .bpe import slices
from .near_dup import GOLDEN, U, mixed

LENGTH = 400
GRAM = 32
#: Words of a passage, and of the hash that is its anchor.
WORDS = 51
WORD_GRAM = 8
#: Words of text whose anchors are searched at once.
CHUNK_WORDS = 1 << 17
#: In place of a span: the text shares a passage; the text stands more than once.
PASSAGE, COPY = -1, -2
#: Bytes of text of a batch for each task slot of the session.
SLOT_BYTES = 128 << 20
#: Arrays of a level that are merged.
FAN = 4
#: Bytes of one suffix's different stretches that a task compares.
GROUP_BYTES = 2 << 20
#: Bytes of stretches of several suffixes that a task compares at once.
HELD = 1 << 20
#: Bytes of text whose anchors are searched at once.
CHUNK = 1 << 20
#: Texts that a task remembers to have seen.
SEEN = 200_000

ENTRIES = "suffix binary, digest binary, text_key binary, start int, n int"
SPANS = "text_key binary, start int, stop int"


@functools.lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * GOLDEN) | U(1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: of the end of one block and the start of the next."""
    n = len(x)
    if n < width:
        return x[:0]
    rows = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def gram_hashes(have: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` neighbours, a power of two."""
    factor, size = U(0xD1342543DE82EF95), 1
    with np.errstate(over="ignore"):
        while size < gram:
            have = have[:-size] * factor + have[size:]
            factor, size = factor * factor, 2 * size
        return mixed(have)


def stretches(sizes: np.ndarray, hashed: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Where each piece of ``sizes`` units begins; and for each stretch its piece, first string of ``length`` units, number of
    strings and anchor (places in all pieces). ``hashed`` are the grams of all pieces one after another."""
    base, strings = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    if not strings.sum():
        return base, *[np.zeros(0, np.int64)] * 4
    piece = np.repeat(np.arange(len(sizes)), strings)
    string = np.arange(len(piece)) - np.repeat(np.cumsum(strings) - strings, strings) + base[piece]
    # Upper half of the hash, then the place: the leftmost of equals is the smallest.
    placed = (hashed & U(0xFFFFFFFF << 32)) | np.arange(len(hashed), dtype=U)
    gram = int(sizes.sum()) - len(hashed) + 1
    anchor = (sliding_min(placed, length - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)[string]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return base, piece[first], string[first], np.diff(np.r_[first, len(anchor)]), anchor[first]


def entries_and_spans(keys: list[bytes], offsets: list[int], pieces: list[bytes]) -> pa.RecordBatch:
    """ENTRIES of pieces of texts. A stretch that stands more than once among them gives one entry, and spans (rows without
    suffix) for all its places, so that what many texts share is a row for each task and not for each text."""
    data, sizes = b"".join(pieces), np.array([len(p) for p in pieces], np.int64)
    base, piece, start, n, anchor = stretches(sizes, gram_hashes(byte_values()[np.frombuffer(data, np.uint8)], GRAM), LENGTH)
    digest = [xxhash.xxh3_128_digest(data[a : a + k + LENGTH - 1]) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
    count = Counter(digest)
    place = start - base[piece] + np.array(offsets, np.int64)[piece]
    last = {d: i for i, d in enumerate(digest)}
    own = np.array(sorted(last.values()), np.int64)
    again = np.flatnonzero([count[d] > 1 for d in digest]) if len(last) < len(digest) else own[:0]
    suffix: list[bytes | None] = [data[a : a + GRAM] for a in anchor[own].tolist()]
    rows = [(piece[own], place[own], n[own])]
    if len(again):
        p, a, b = piece[again], place[again], (place + n)[again]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (a[1:] != b[:-1])])
        rows.append((p[new], a[new], np.r_[b[new[1:] - 1], b[-1:]] - a[new]))
        suffix += [None] * len(new)
    which, at, strings = (np.concatenate(x) for x in zip(*rows, strict=True))
    digests = [digest[i] for i in own.tolist()] + [None] * (len(which) - len(own))
    return pa.RecordBatch.from_arrays(
        [pa.array(suffix, pa.binary()), pa.array(digests, pa.binary()), pa.array([keys[i] for i in which.tolist()], pa.binary()), pa.array(at.astype(np.int32)), pa.array(strings.astype(np.int32))],
        names=["suffix", "digest", "text_key", "start", "n"],
    )


@functools.lru_cache(maxsize=1)
def is_space() -> np.ndarray:
    return np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def spaced(data: bytes) -> bytes:
    """The words with one space between them."""
    x = np.frombuffer(data, np.uint8)
    space = is_space()[x]
    keep = ~space
    keep[1:] |= ~space[:-1]
    return np.where(space, np.uint8(0x20), x)[keep].tobytes().strip(b" ")


@functools.lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd factor and of its inverse, modulo 2**64."""
    factor = 0xD1342543DE82EF95
    return tuple(np.multiply.accumulate(np.r_[U(1), np.full(size, f, U)]) for f in (factor, pow(factor, -1, 1 << 64)))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends (its space), and a hash of it."""
    x = np.frombuffer(data, np.uint8)
    stop = np.flatnonzero(x == 0x20)
    start = np.r_[0, stop[:-1] + 1]
    up, down = powers(max(2 * CHUNK, 1 << len(x).bit_length()))
    with np.errstate(over="ignore"):
        total = np.cumsum(byte_values()[x] * up[: len(x)])
        return start, stop, mixed((total[stop] - total[start] + byte_values()[x[start]] * up[start]) * down[start])


def words_digest(data: bytes) -> bytes:
    """Never that of a stretch or string of the same bytes, which may stand beside it in a table."""
    return xxhash.xxh3_128_digest(data, seed=WORDS)


def passage_entries(keys: list[bytes], offsets: list[int], pieces: list[bytes]) -> pa.RecordBatch:
    """ENTRIES of passages in pieces of spaced texts; n is given as if LENGTH bytes began at each of so many places. Texts that share
    a whole stretch with another one among them are marked at once, and it gives one entry."""
    data = b" ".join(pieces) + b" "
    begin, end, have = word_hashes(data)
    hashed = gram_hashes(have, WORD_GRAM)
    _, piece, first, n, anchor = stretches(np.array([p.count(b" ") + 1 for p in pieces], np.int64), hashed, WORDS)
    a, b = begin[first], end[first + n + WORDS - 2]
    digest = [words_digest(data[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    holder: dict[bytes, bytes] = {}
    own_key = [keys[i] for i in piece.tolist()]
    far = {d for d, key in zip(digest, own_key, strict=True) if holder.setdefault(d, key) != key}
    marked = {key for d, key in zip(digest, own_key, strict=True) if d in far} if far else ()
    own = np.array(sorted({d: i for i, d in enumerate(digest)}.values()), np.int64)
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    at = (a - (np.cumsum(sizes) - sizes)[piece] + np.array(offsets, np.int64)[piece])[own]
    grams, none = hashed[anchor[own]].astype("<u8").tobytes(), [None] * len(marked)
    columns = [
        [grams[i : i + 8] for i in range(0, len(grams), 8)] + none,
        [digest[i] for i in own.tolist()] + none,
        [own_key[i] for i in own.tolist()] + list(marked),
        np.r_[at, np.full(len(marked), PASSAGE)].astype(np.int32),
        np.r_[(b - a)[own] - LENGTH + 1, np.full(len(marked), 1 - LENGTH)].astype(np.int32),
    ]
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["suffix", "digest", "text_key", "start", "n"])


def word_pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a spaced text, and where they begin; every passage is in one of them."""
    n = data.count(b" ") + 1
    if n <= CHUNK_WORDS + WORDS:
        if n >= WORDS:
            yield 0, data
        return
    stop = np.r_[np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20), len(data)]
    for i in range(0, n - WORDS + 1, CHUNK_WORDS):
        at = int(stop[i - 1]) + 1 if i else 0
        yield at, data[at : stop[min(i + CHUNK_WORDS + WORDS - 1, n) - 1]]


def suffixes(docs: DataFrame) -> DataFrame:
    """ENTRIES of texts (text_key, text), and spans of strings already known to be repeated (suffix is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, CHUNK):
                keys, offsets, pieces = [], [], []
                words: tuple[list, list, list] = [], [], []
                for key, text in zip(part.column("text_key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if key in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(key)
                    data = (text or "").encode()
                    for at in range(0, len(data) - LENGTH + 1, CHUNK):
                        keys.append(key), offsets.append(at), pieces.append(data[at : at + CHUNK + LENGTH - 1])
                        if at:
                            yield entries_and_spans(keys, offsets, pieces)
                            keys, offsets, pieces = [], [], []
                    for at, piece in word_pieces(spaced(data)):
                        words[0].append(key), words[1].append(at), words[2].append(piece)
                        if at:
                            yield passage_entries(*words)
                            words = [], [], []
                if pieces:
                    yield entries_and_spans(keys, offsets, pieces)
                if words[0]:
                    yield passage_entries(*words)

    return docs.select("text_key", "text").mapInArrow(run, ENTRIES)


class SuffixArray:
    """Rows in buckets of their suffix, in order of bytes; a table of the session over files in the shared folder."""

    def __init__(self, rows: DataFrame, buckets: int, label: str) -> None:
        self.spark, self.name, self.path = rows.sparkSession, f"{label}_{uuid.uuid4().hex}", new_path(rows.sparkSession, label)
        order = [c for c in ("suffix", "digest") if c in rows.columns]
        dealt = rows.repartition(buckets, "suffix").distinct()  # copies of a text meet here
        dealt.write.option("compression", "zstd").bucketBy(buckets, "suffix").sortBy(*order).option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.name}")
        delete(self.spark, self.path)


class Family:
    """Levels of suffix arrays, fewer than ``fan`` on each, and the suffixes found more than once so far."""

    def __init__(self, buckets: int, fan: int = FAN) -> None:
        self.buckets, self.fan = buckets, fan
        self.levels: defaultdict[int, list[SuffixArray]] = defaultdict(list)
        self.shared: list[DataFrame] = []

    def arrays(self) -> list[SuffixArray]:
        return [array for level in self.levels.values() for array in level]

    def add(self, rows: DataFrame) -> None:
        """Scans a batch's array against itself and all of the family, then merges full levels."""
        new = SuffixArray(rows, self.buckets, "suffix_batch")
        left = new.rows().groupBy("suffix").agg(F.count(F.lit(1)).alias("c"))
        hits = left.where("c > 1").select("suffix")
        left = left.where("c = 1").select("suffix")
        for array in self.arrays():  # a suffix is reported once, and not looked for again
            theirs = array.rows().select("suffix").hint("merge")
            hits = hits.unionAll(left.join(theirs, "suffix", "left_semi"))
            left = left.join(theirs, "suffix", "left_anti")
        self.shared.append(staged(hits, "suffix-shared"))
        self.levels[0].append(new)
        at = 0
        while len(self.levels[at]) == self.fan:
            full = self.levels.pop(at)
            at += 1
            self.levels[at].append(SuffixArray(functools.reduce(DataFrame.unionAll, [array.rows() for array in full]), self.buckets, "suffix_level"))
            for array in full:
                array.drop()

    def candidates(self) -> DataFrame:
        """All entries whose suffix stands more than once, as a table."""
        keys = SuffixArray(functools.reduce(DataFrame.unionAll, self.shared), self.buckets, "suffix_keys")
        found = [array.rows().join(keys.rows().hint("merge"), "suffix", "left_semi") for array in self.arrays()]
        out = staged(functools.reduce(DataFrame.unionAll, found), "suffix-candidates")
        for array in (keys, *self.arrays()):
            array.drop()
        discard(*self.shared)
        return out


WANTED = "key long, string binary, text_key binary, start int, alone boolean, bytes binary, stop int"
WANTED_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.int32())


def wanted_rows(columns: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in WANTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, WANTED_KINDS, strict=True)], names=names)


def passages(data: bytes) -> list[bytes]:
    """Digests of all WORDS words in a row of a spaced text."""
    stop = [*np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20).tolist(), len(data)]
    return [words_digest(data[a:b]) for a, b in zip([0, *[i + 1 for i in stop]], stop[WORDS - 1 :], strict=False)]


def sharing(rows: list[tuple]) -> tuple[set[bytes], dict[bytes, tuple]]:
    """Among stretches of words (key, text_key, start, alone, bytes) the texts that have a passage of another one, and (key,
    text_key) of one place of each passage."""
    holder: dict[bytes, tuple] = {}
    marked = set()
    for key, text_key, *_, data in rows:
        for passage in passages(data):
            other = holder.setdefault(passage, (key, text_key))[1]
            if other != text_key:
                marked |= {other, text_key}
    return marked, holder


def strings_and_spans(rows: list[tuple]) -> pa.RecordBatch:
    """WANTED of stretches (key, text_key, start, alone, bytes) string by string. Of a string that stands more than once
    among them one row is enough, and spans (rows with a stop) for its places."""
    marked, holder = sharing([r for r in rows if r[2] < 0])
    rows = [r for r in rows if r[2] >= 0]
    digests = [[xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(len(data) - LENGTH + 1)] for *_, data in rows]
    count = Counter(d for own in digests for d in own)
    out, given = [(key, d, text_key, PASSAGE, False, None, None) for d, (key, text_key) in holder.items()], set()
    out += [(0, text_key, text_key, PASSAGE, True, None, PASSAGE) for text_key in marked]
    for (key, text_key, start, alone, _), own in zip(rows, digests, strict=True):
        again = np.array([count[d] > 1 for d in own])
        if alone:
            out += [(key, text_key, text_key, start + int(a), True, None, start + int(b) + LENGTH - 1) for a, b in zip(*runs(again), strict=True)]
        for i, d in enumerate(own):
            if count[d] == 1:
                out.append((key, d, text_key, start + i, alone, None, None))
            elif d not in given:
                given.add(d)
                out.append((key, d, text_key, start + i, False, None, None))
    return wanted_rows(list(zip(*out, strict=True)))


def bytes_of(wanted: DataFrame, docs: DataFrame, one: DataFrame) -> DataFrame:
    """WANTED of stretches (key, words, alone, large, text_key, start, n), read from one row of each text: a row with its bytes for
    each, and where it is large a row with the digest of each of its strings."""
    lists = wanted.groupBy("text_key").agg(F.collect_list(F.struct("key", "start", "n", "words", "alone", "large")).alias("wanted"))  # at most the text's own stretches
    lists = lists.join(one, "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, CHUNK):
                small, large = [], []
                for text_key, text, wanted in zip(*[part.column(c).to_pylist() for c in ("text_key", "text", "wanted")], strict=True):
                    data = text.encode()
                    words = spaced(data) if any(w["words"] for w in wanted) else b""
                    for w in wanted:
                        own = (words if w["words"] else data)[w["start"] : w["start"] + w["n"] + LENGTH - 1]
                        start = PASSAGE if w["words"] else w["start"]
                        if w["large"]:
                            large.append((w["key"], text_key, start, w["alone"], own))
                        else:
                            small.append((w["key"], None, text_key, start, w["alone"], own, None))
                if small:
                    yield wanted_rows(list(zip(*small, strict=True)))
                at = size = 0
                for i, row in enumerate(large):
                    size += len(row[4])
                    if size > HELD or i + 1 == len(large):
                        yield strings_and_spans(large[at : i + 1])
                        at, size = i + 1, 0

    joined = docs.join(lists, (docs["text_key"] == lists["text_key"]) & docs["doc_id"].eqNullSafe(lists["one"]))
    return joined.select(docs["text_key"], "text", "wanted").mapInArrow(run, WANTED)


def ranks(data: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Rank of each string of LENGTH bytes (by where it starts) in their order of bytes; equal strings have equal ranks."""

    def ranked(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1]

    word = data.astype(U)
    for k in (1, 2, 4):
        word = (word[:-k] << U(8 * k)) | word[k:]
    size, rank, total, done = 8, ranked(word), None, 0
    parts = {}
    while True:
        if LENGTH & size:
            parts[size] = rank
        if 2 * size > LENGTH:
            break
        rank = ranked(rank[:-size] * len(rank) + rank[size:])
        size *= 2
    for size in sorted(parts, reverse=True):
        piece = parts[size][strings + done]
        total, done = piece if total is None else ranked(total * len(data) + piece), done + size
    return total


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of LENGTH bytes from every place on, put together from those of 1, 2, 4, ... bytes."""
    have, factor, size = byte_values()[data], U(0xD1342543DE82EF95), 1
    total, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if LENGTH & size:
                total = have if total is None else have[: len(data) - done - size + 1] * power + total[size:]  # the longer part goes first
                done += size
                power = factor if done == size else power * factor
            if 2 * size > LENGTH:
                return total
            have = have[:-size] * factor + have[size:]
            factor, size = factor * factor, 2 * size


def repeated(data: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Which strings of LENGTH bytes (by where they start, ascending) equal another one of them. Strings of one hash are
    compared with the one before: all bytes, or the last one where the strings one byte before were compared as well."""
    hashed = mixed(hashes(data)[strings])
    order = np.argsort(hashed, kind="stable")
    hashed = hashed[order]
    same = np.flatnonzero(hashed[1:] == hashed[:-1])
    found = np.zeros(len(strings), bool)
    if not len(same):
        return found
    before = np.full(len(strings), -1)
    before[order[same + 1]] = strings[order[same]]
    which = np.flatnonzero(before >= 0)
    ours, theirs = strings[which], before[which]
    first = np.r_[True, (ours[1:] != ours[:-1] + 1) | (theirs[1:] != theirs[:-1] + 1)]
    equal = (data[ours + LENGTH - 1] == data[theirs + LENGTH - 1]).all()
    ours, theirs = ours[first], theirs[first]
    word = data.astype(U)
    for k in (1, 2, 4):
        word = (word[:-k] << U(8 * k)) | word[k:]
    for at in range(0, LENGTH - 7, 8):
        equal = equal and (word[ours + at] == word[theirs + at]).all()
    if not equal:
        rank = ranks(data, strings)
        return np.bincount(rank)[rank] > 1
    found[order[same]] = found[order[same + 1]] = True
    return found


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPANS of repeated strings among WANTED in order of (key, string); a key's stretches are looked at together."""

    def spans(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["text_key", "start", "stop"])

    def look(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        marked, _ = sharing([r for r in rows if r[2] < 0])
        if marked:
            yield spans([list(marked), [PASSAGE] * len(marked), [PASSAGE] * len(marked)])
        rows = [r for r in rows if r[2] >= 0]
        if not rows:
            return
        sizes = np.array([len(r[4]) for r in rows])
        n = sizes - LENGTH + 1
        first = np.cumsum(n) - n
        strings = np.arange(n.sum()) + np.repeat(np.cumsum(sizes) - sizes - first, n)
        again = repeated(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), strings)
        again &= np.repeat(np.array([r[3] for r in rows]), n)
        begins, ends = runs(np.insert(again, first[1:], False))  # a gap before each stretch but the first
        row = np.searchsorted(first + np.arange(len(rows)), begins, "right") - 1
        base = np.array([r[2] for r in rows]) - first - np.arange(len(rows))
        yield spans([[rows[i][1] for i in row.tolist()], (begins + base[row]).astype(np.int32), (ends + base[row] + LENGTH - 1).astype(np.int32)])

    held: list[tuple] = []
    size, last, open_, first = 0, None, None, None
    for batch in batches:
        known = batch.filter(pa.compute.is_valid(batch.column("stop")))
        if known.num_rows:
            yield known.select(["text_key", "start", "stop"])
        single = batch.filter(pa.compute.and_(pa.compute.is_valid(batch.column("string")), pa.compute.is_null(batch.column("stop"))))
        out = []
        for string, text_key, start, alone in zip(*[single.column(c).to_pylist() for c in ("string", "text_key", "start", "alone")], strict=True):
            here = (text_key, start, start + LENGTH) if alone else None
            if string != last:
                last, open_, first = string, here, text_key
                continue
            if start < 0:
                out += [(x, PASSAGE, PASSAGE) for x in (first, text_key) if text_key != first]
                continue
            out += [x for x in (open_, here) if x]
            open_ = None
        if out:
            yield spans(list(zip(*out, strict=True)))
        for part in slices(batch.filter(pa.compute.is_valid(batch.column("bytes"))), HELD, "bytes"):
            for row in zip(*[part.column(c).to_pylist() for c in ("key", "text_key", "start", "alone", "bytes")], strict=True):
                if size > HELD and row[0] != held[-1][0]:
                    yield from look(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
    if held:
        yield from look(held)


def batches_of(n_bytes: int, spark: SparkSession, slot_bytes: int) -> int:
    """Batches of as much text as all task slots take at once."""
    return max(1, -(-n_bytes // (slot_bytes * spark.sparkContext.defaultParallelism)))


def repeated_spans(docs: DataFrame, one: DataFrame, n_bytes: int, slot_bytes: int = SLOT_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """SPANS of repeated strings in the different texts of docs (doc_id, text_key, text), of n_bytes together."""
    spark = docs.sparkSession
    batches = batches_of(n_bytes, spark, slot_bytes)
    batch = F.when(F.col("suffix").isNotNull(), F.pmod(F.xxhash64("text_key"), F.lit(batches))).otherwise(-1).cast("int").alias("batch")
    path = new_path(spark, "suffix-entries")
    suffixes(docs).select("*", batch).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    entries = spark.read.schema(f"{ENTRIES}, batch int").parquet(path)
    stop = (F.col("start") + F.col("n") + LENGTH - 1).alias("stop")
    known = staged(entries.where("batch = -1").select("text_key", "start", stop), "suffix-known")
    family = Family(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in range(batches):
        family.add(entries.where(F.col("batch") == i).drop("batch"))
    delete(spark, path)
    shared = family.candidates()

    # Every place with how often its stretch stands, in one shuffle; tasks left one entry of what they saw again.
    same = W.partitionBy("digest")
    placed = shared.select("digest", F.xxhash64("suffix").alias("key"), (F.octet_length("suffix") < GRAM).alias("words"), "text_key", F.xxhash64("text_key").alias("t"), "start", "n")
    placed = placed.withColumn("c", F.count(F.lit(1)).over(same)).withColumn("nth", F.row_number().over(same.orderBy("text_key", "start")))
    again = F.when(F.col("words"), F.min("t").over(same) < F.max("t").over(same)).otherwise(F.col("c") > 1)  # a passage: in another text
    placed = staged(placed.withColumn("again", again).drop("digest", "c"), "suffix-placed")
    discard(shared)
    kinds = placed.where("nth = 1")
    where = [F.when(F.col("words"), PASSAGE).otherwise(x).alias(name) for x, name in ((F.col("start"), "start"), (stop, "stop"))]
    whole = staged(placed.where("again").select("text_key", *where), "suffix-whole")
    several = F.count(F.lit(1)).alias("kinds"), F.max(~F.col("again")).alias("left"), (~F.max("words") | (F.min("t") < F.max("t"))).alias("apart")
    open_ = kinds.groupBy("key").agg(*several, F.sum(F.col("n") + LENGTH - 1).alias("bytes")).where("kinds > 1 and left and apart").select("key", "bytes")
    large = (F.col("bytes") > group_bytes).alias("large")
    wanted = staged(kinds.join(open_.hint("merge"), "key").select("key", large, "words", (~F.col("again")).alias("alone"), "text_key", "start", "n"), "suffix-wanted")
    discard(placed)
    return bytes_of(wanted, docs, one).repartition("key", "string").sortWithinPartitions("key", "string").mapInArrow(compared, SPANS).unionAll(whole).unionAll(known)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans, kept, shares_passage of texts and their spans."""
    for batch in batches:
        for part in slices(batch):
            rows = []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data, kept, removed, n, stop = (text or "").encode(), [], 0, 0, -1
                marks = {x["start"] for x in found or () if x["start"] < 0}
                shares = PASSAGE in marks or (COPY in marks and spaced(data).count(b" ") >= WORDS - 1)
                for a, b in sorted((x["start"], x["stop"]) for x in found or () if x["start"] >= 0):
                    if a > stop:
                        kept.append(data[max(stop, 0) : a])
                        n += 1
                    removed += max(0, b - max(a, stop))
                    stop = max(stop, b)
                kept.append(data[max(stop, 0) :])
                rows.append((len(data), removed, n, b"".join(kept), shares))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "shares_passage"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bytes: int = SLOT_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the rest, which may cut characters),
    shares_passage (it has WORDS words in a row that another row has too; such a passage may be too short to be removed).

    Texts too short for WORDS words never move.
    """
    own = texts(docs, id_col, text_col)
    is_long = F.octet_length(F.coalesce("text", F.lit(""))) >= min(LENGTH, 2 * WORDS - 1)
    long_ = own.where(is_long).withColumn("text_key", F.unhex(F.md5("text")))
    copies = long_.groupBy("text_key").agg(F.count(F.lit(1)).alias("c"), F.first(F.octet_length("text")).alias("n"), F.min("doc_id").alias("one"))
    copies = staged(copies, "suffix-texts")
    n_bytes = copies.agg(F.sum("n").cast("long")).head()[0] or 0
    spans = repeated_spans(long_, copies.select("text_key", "one"), n_bytes, slot_bytes, group_bytes)
    spans = spans.unionAll(copies.where(f"c > 1 and n >= {LENGTH}").select("text_key", F.lit(0).alias("start"), F.col("n").cast("int").alias("stop")))
    spans = spans.unionAll(copies.where("c > 1").select("text_key", F.lit(COPY).alias("start"), F.lit(COPY).alias("stop")))
    lists = staged(spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "suffix-spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, shares_passage boolean"
    short = own.where(~is_long).select("doc_id", "text", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans"))
    return long_.join(lists.hint("merge"), "text_key", "left").select("doc_id", "text", "spans").mapInArrow(cut, schema).unionAll(short.mapInArrow(cut, schema))
