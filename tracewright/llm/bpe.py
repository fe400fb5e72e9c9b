"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one encoding, so exactly one last token. An Aho-Corasick automaton (a trie of the
vocabulary with suffix links) lists the tokens that end at each position; of those, the one that may stand after the
last token of the remaining prefix is kept. Following these back-pointers from the end gives the ids. The work is linear
in the length of a piece, however long a run without a break is.

Whether two tokens may stand side by side is decided by taking the two apart along their common border, the part that
was merged last first, and looking for a merge across the border that the encoder would have made earlier.

Null text counts as empty and gives no ids; a row is returned for every input row, repeated ones included.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from ._jobs import texts

#: What the byte-level format prints as itself, its pattern for pieces, and the white space of that pattern.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Units of each generation that a worker remembers, and pairs; a full table of pairs is emptied. Bounds memory only.
REMEMBERED = 80_000
CACHED_PAIRS = 250_000
NEVER = 1 << 60


def byte_characters() -> dict[int, str]:
    """The character that the format prints for each byte: itself, or the next free one from 256 on."""
    return {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


class Vocabulary:
    """Tokens, merges and the automaton of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        byte_of = {c: b for b, c in byte_characters().items()}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        self.size = max(self.bytes_of) + 1
        self.rank, self.parts, self.merge = {}, {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merge[a << 24 | b] = rank
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (a, b)
        self.fits = Fits(self)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i not in self.parts or self.whole(i):
                own = self.bytes_of[i].decode("latin-1")
                self.automaton.add_word(own, (len(own), i))
        self.automaton.make_automaton()

    def whole(self, token: int) -> bool:
        """The encoder makes this token of its own bytes: nothing crosses its last seam before its own merge."""
        return self.side_by_side(*self.parts[token], self.rank[token])

    def side_by_side(self, left: int, right: int, until: int = NEVER) -> bool:
        """No merge across the border comes before what the two tokens become part of, at rank until."""
        rank, parts, merge = self.rank, self.parts, self.merge
        left_until = right_until = until
        while True:
            across = merge.get(left << 24 | right)
            # Of equal merges the leftmost is made first: one inside the left token wins, one inside the right loses.
            if across is not None and across < left_until and (across <= right_until if right_until < until or until == NEVER else across < until):
                return False
            made_left, made_right = rank.get(left, -1), rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left_until, left = made_left, parts[left][1]
            else:
                right_until, right = made_right, parts[right][0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece; its characters stand for bytes."""
        last, start_of = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        fits = self.fits
        for at, (length, token) in self.automaton.iter(piece):
            end = at + 1
            if last[end] < 0 and (length == end or fits[last[end - length] << 24 | token]):
                last[end], start_of[end] = token, end - length
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end = start_of[end]
        return ids[::-1]


class Fits(dict):
    """Remembers side_by_side of pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        if len(self) > CACHED_PAIRS:
            self.clear()
        self[pair] = fit = self.vocabulary.side_by_side(pair >> 24, pair & 0xFFFFFF)
        return fit


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are white space."""
    short, long_ = ({c.encode() for c in SPACES if (len(c.encode()) > 1) == more} for more in (False, True))
    table = np.zeros(256, bool)
    table[[c[0] for c in short]] = True
    found = table[data]
    leads = np.zeros(256, bool)
    leads[[c[0] for c in long_]] = True
    for at in np.flatnonzero(leads[data]).tolist() if leads[data].any() else ():
        for size in (2, 3):
            if data[at : at + size].tobytes() in long_:
                found[at : at + size] = True
    return found


def letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(65, 91), *range(97, 123)]] = True
    return table


def units(texts_: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, and how many each has. A unit's ids don't depend on the rest, since no piece goes across its
    ends: a text is cut where white space begins, after a newline that stands alone, and where a letter (of ASCII or
    Latin-1) is before another sign of ASCII."""
    sizes = np.array([len(t) for t in texts_], np.int64)
    joined = b"".join(texts_)
    data = np.frombuffer(joined, np.uint8)
    space, letter = white(data), LETTERS[data]
    sign = ~(letter | space) & (data < 128)
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[1:] |= letter[:-1] & sign[1:]
    cut[2:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7) & sign[2:]
    cut[2:] |= (data[1:-1] == 10) & ~(space[2:] | space[:-2])
    first = np.cumsum(sizes) - sizes
    cut[first[sizes > 0]] = True
    at = np.flatnonzero(cut)
    array = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[at, len(data)].astype(np.int32)), pa.py_buffer(joined)])
    return array, np.searchsorted(at, first + sizes) - np.searchsorted(at, first)


LETTERS = letters()


class Remembered:
    """What ``make`` gave for units used lately, in two generations: a full young one becomes the old one."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int = REMEMBERED) -> None:
        self.make, self.most = make, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, asked: list[bytes]) -> list[bytes]:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, asked))
        open_ = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = old.get(asked[i])
            if ids is None:
                open_.append(i)
            else:
                out[i] = young[asked[i]] = ids
        if open_:
            for i, ids in zip(open_, self.make([asked[i] for i in open_]), strict=True):
                out[i] = ids
                if len(asked[i]) < 200:
                    young[asked[i]] = ids
        return out

    def get(self, unit: bytes) -> bytes | None:
        return self.young.get(unit) or self.old.get(unit)


def by_units(texts_: list[bytes], known: Remembered, kind: str) -> list[np.ndarray]:
    """Ids of every text; each distinct unit is asked for once."""
    array, counts = units(texts_)
    coded = array.dictionary_encode()
    found = known(coded.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(found), kind)
    sizes = np.fromiter(map(len, found), np.int32, len(found)) // flat.itemsize
    which = coded.indices.to_numpy()
    n = sizes[which]
    ends = np.cumsum(n, dtype=np.int64)
    place = np.repeat((np.cumsum(sizes, dtype=np.int64) - sizes)[which] - (ends - n), n)
    place += np.arange(len(place))
    return np.split(flat[place], np.r_[0, ends][np.cumsum(counts)][:-1]) if len(texts_) else []


class Encoder:
    """Encodes whole texts as the tokenizers library does, special strings included."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PIECE).findall
        self.known = Remembered(self.made)
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None

    def made(self, asked: list[bytes]) -> list[bytes]:
        return [b"".join(map(self.piece, found)) if len(found := self.find(u.decode())) > 1 else self.piece(found[0]) for u in asked]

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = self.known.get(raw)
        if ids is None:
            ids = np.array(self.vocabulary.encode_piece(raw.decode("latin-1")), "<u4").tobytes()
            if len(raw) < 200:
                self.known.young[raw] = ids
        return ids

    def encode_all(self, texts_: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a text with special strings is several texts and those strings' ids."""
        added, parts, owner = self.vocabulary.added, [], []
        for i, text in enumerate(texts_):
            own = self.special.split(text) if text and any(x in text for x in added) else [text or ""]
            parts += own
            owner += [i] * len(own)
        plain = iter(by_units([p.encode() for p in parts if p not in added], self.known, "<u4"))
        ids = [np.array([added[p]], "<u4") if p in added else next(plain) for p in parts]
        if len(parts) == len(texts_):
            return ids
        out: list[list[np.ndarray]] = [[] for _ in texts_]
        for i, x in zip(owner, ids, strict=True):
            out[i].append(x)
        return [np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(Vocabulary(path))


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian 32-bit integers) and the text that decoding those ids gives.

    One pass over the rows without a shuffle; memory in a task is a batch of texts and bounded caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                ids = coder.encode_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def slices(batch: pa.RecordBatch, size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of a column each, a row at least."""
    lengths = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = lengths[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lengths, done + size, "right")))
        yield batch.slice(at, end - at)
        at = end
