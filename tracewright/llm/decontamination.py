"""Benchmark decontamination: BM25 over test items with block-max WAND, then verification of question and answer.

Test items, in segments of at most SEGMENT words, are the indexed documents; every passage of WINDOW words of every
training text, one each SEGMENT words, is a query with its distinct words. A segment's impacts are divided by the score
of the segment on itself, so that 1 means that all of it was found and one threshold fits all.

A segment's commonest words, with impacts of at most SLACK together, can't lift a passage over the threshold by
themselves; their lists aren't opened in the search. Segments lie in blocks of BLOCK, with the largest impact of each
(term, block). The bounds of all (passage, block) pairs that a list of a passage touches are added up at once; blocks
that reach the threshold are opened, and their segments, if essential words alone leave them the chance, get the full
score. So all passages at or above the threshold are found.

For each text and item found, the shares of the 5-word shingles of the question and of the answer (the item's last
sentence, or its second half) that stand in the whole text are measured; each of the two has to reach OVERLAP. An item of
one word is all question.

Test items are taken in passes of about WORDS_A_PASS words each, as many passes as they need. Null or empty texts and
items match nothing. Different texts under one item id, or under none, are items of their own: each one found gives a
row with that id. Rows repeated under one id are looked at one by one; results are distinct. A very long text is one
task's row: its words and the sets of shingles of matched texts are held at once. No passes, no rows: an empty table of
documents or items gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._jobs import on_workers, staged, texts
from .bpe import slices

SEGMENT = 64
WINDOW = 2 * SEGMENT
SHINGLE = 5
THRESHOLD = 0.5
SLACK = 0.2
OVERLAP = 0.8
BLOCK = 64
K1, B = 1.2, 0.75
WORDS_A_PASS = 2_000_000
WORDS_HELD = 400_000

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE = re.compile(r"[.!?]\s+|\n")


def bare(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else EDGE.sub("", word)


def words_of(text: str | None) -> list[str]:
    return [w for w in map(bare, (text or "").split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    ends = [m.end() for m in SENTENCE.finditer(text.strip())]
    if ends and (answer := words_of(text.strip()[ends[-1] :])) and (question := words_of(text.strip()[: ends[-1]])):
        return question, answer
    words = words_of(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def postings(items: DataFrame) -> DataFrame:
    """item_id (a key of id and text), segment, size, term, tf, df, mean_size, n: the index as rows, with counts over all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, len(words), SEGMENT):
                    own = words[at : at + SEGMENT]
                    rows += [(item, at // SEGMENT, len(own), w, own.count(w)) for w in dict.fromkeys(own)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["item_id", "segment", "size", "term", "tf"])

    rows = staged(items.mapInArrow(run, "item_id string, segment int, size int, term string, tf int"), "decontamination-index")
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = rows.select("item_id", "segment", "size").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"))
    return rows.join(df, "term").crossJoin(F.broadcast(sizes))  # sizes is one row


class Index:
    """One pass's segments: impacts by term, block maxima, and what verification needs."""

    def __init__(self, rows: list, item_texts: dict, item_ids: dict | None = None):
        self.item_ids = item_ids or {i: i for i in item_texts}
        self.parts = {i: tuple(shingles(p) for p in question_and_answer(t or "")) for i, t in item_texts.items()}
        by_segment = defaultdict(dict)
        for r in rows:
            idf = math.log(1 + (r["n"] - r["df"] + 0.5) / (r["df"] + 0.5))
            by_segment[r["item_id"], r["segment"]][r["term"]] = idf * r["tf"] * (K1 + 1) / (r["tf"] + K1 * (1 - B + B * r["size"] / r["mean_size"]))
        self.segments = sorted(by_segment)
        self.impacts, self.rest = [], np.zeros(len(self.segments))
        lists = defaultdict(list)
        common = {r["term"]: r["df"] for r in rows}
        for s, name in enumerate(self.segments):
            own = by_segment[name]
            whole = sum(own.values())
            own = {t: v / whole for t, v in own.items()}
            self.impacts.append(own)
            for t in sorted(own, key=lambda t: (-common[t], t)):
                if self.rest[s] + own[t] > SLACK:
                    break
                self.rest[s] += own[t]
                lists[t].append((s, 0.0))
            for t, v in own.items():
                if not (lists[t] and lists[t][-1] == (s, 0.0)):
                    lists[t].append((s, v))
        essential = {t: [x for x in found if x[1] > 0] for t, found in lists.items()}
        essential = {t: found for t, found in essential.items() if found}
        self.term = {t: i for i, t in enumerate(sorted(essential))}
        # Flat lists by term, of (block, largest impact) and of (segment, impact).
        block_rows, segment_rows = [], []
        for t in sorted(essential):
            most = defaultdict(float)
            for s, v in essential[t]:
                most[s // BLOCK] = max(most[s // BLOCK], v)
            block_rows.append(sorted(most.items()))
            segment_rows.append(essential[t])
        self.block_at, self.blocks, self.block_max = flat(block_rows)
        self.segment_at, self.segment_of, self.impact = flat(segment_rows)
        n_blocks = -(-len(self.segments) // BLOCK)
        self.block_rest = np.array([self.rest[b * BLOCK : (b + 1) * BLOCK].max() for b in range(n_blocks)])

    def search(self, terms: np.ndarray, passages: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, segment) pairs that may reach the threshold, from distinct (passage, essential term) pairs."""
        row, at = spread(self.block_at, terms)
        key, total = added(passages[row] * len(self.block_rest) + self.blocks[at], self.block_max[at])
        opened = key[total + self.block_rest[key % len(self.block_rest)] >= THRESHOLD - 1e-9]
        if not len(opened):
            return opened, opened
        live = np.zeros(n_passages, bool)
        live[opened // len(self.block_rest)] = True
        mine = live[passages]
        row, at = spread(self.segment_at, terms[mine])
        owner, segment = passages[mine][row], self.segment_of[at]
        inside = np.isin(owner * len(self.block_rest) + segment // BLOCK, opened)
        key, total = added(owner[inside] * len(self.segments) + segment[inside], self.impact[at][inside])
        key = key[total + self.rest[key % len(self.segments)] >= THRESHOLD - 1e-9]
        return key // len(self.segments), key % len(self.segments)


def flat(rows: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum([0, *map(len, rows)])
    every = [x for r in rows for x in r]
    return at, np.array([x[0] for x in every], np.int64), np.array([x[1] for x in every])


def spread(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the lists of all terms: the row of its term, and its place."""
    n = at[terms + 1] - at[terms]
    row = np.repeat(np.arange(len(terms)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + at[terms][row]


def added(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, value
    found, which = np.unique(key, return_inverse=True)
    return found, np.bincount(which, value)


class TermIds(dict):
    """Essential term of a raw word, or -1."""

    def __init__(self, term: dict[str, int]):
        self.term = term

    def __missing__(self, raw: str) -> int:
        self[raw] = i = self.term.get(bare(raw), -1)
        return i


def matches(texts_: list[str | None], index: Index, ids: TermIds) -> list[list[tuple]]:
    """For each text: (item, best score, question overlap, answer overlap) of the items that it holds."""
    if len(ids) > WORDS_HELD:
        ids.clear()
    out: list[list[tuple]] = [[] for _ in texts_]
    if not index.segments:
        return out
    raw = [(t or "").split() for t in texts_]
    counts = np.array([len(r) for r in raw])
    terms = np.fromiter((i for r in raw for i in map(ids.__getitem__, r)), np.int64, int(counts.sum()))
    place = np.flatnonzero(terms >= 0)
    if not len(place):
        return out
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(raw)), counts)[place]
    strides = counts // SEGMENT + 2
    base = np.cumsum(strides) - strides
    here = base[doc] + (place - first[doc]) // SEGMENT + 1
    # The passage that starts in the word's own stride, and the one before; the latter begins with the text for stride 0.
    pair = np.unique(np.concatenate([here, here - 1]) * len(index.term) + np.concatenate([terms[place]] * 2))
    passage, segment = index.search(pair % len(index.term), pair // len(index.term), int(strides.sum()))
    best: dict[tuple[int, int], float] = {}
    held: dict[int, set[str]] = {}
    for p, s in zip(passage.tolist(), segment.tolist(), strict=True):
        d = int(np.searchsorted(base, p, "right")) - 1
        if p not in held:
            start = max(0, (p - int(base[d]) - 1) * SEGMENT)
            held[p] = {bare(w) for w in raw[d][start : (p - int(base[d]) + 1) * SEGMENT]}
        score = sum(v for t, v in index.impacts[s].items() if t in held[p])
        item = index.segments[s][0]
        if score >= THRESHOLD:
            best[d, item] = max(score, best.get((d, item), 0.0))
    sets: dict[int, set] = {}
    for (d, item), score in sorted(best.items()):
        question, answer = index.parts[item]
        words = None
        if d not in sets:
            words = words_of(texts_[d])
            sets[d] = {tuple(words[i : i + k]) for k in {len(x) for x in (*question, *answer)} | {SHINGLE} for i in range(len(words) - k + 1)}
        elif short := {len(x) for x in (*question, *answer)} - {len(x) for x in sets[d]}:
            words = words_of(texts_[d])
            sets[d] |= {tuple(words[i : i + k]) for k in short for i in range(len(words) - k + 1)}
        q, a = (sum(x in sets[d] for x in part) for part in (question, answer))
        if q >= OVERLAP * len(question) and a >= OVERLAP * len(answer):
            out[d].append((index.item_ids[item], score, q / max(1, len(question)), a / max(1, len(answer))))
    return out


def passes(items: DataFrame) -> Iterator[Index]:
    """The index of one bounded share of the items after another."""
    on_workers(items.sparkSession)
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    own = own.select(F.sha2(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit(" "), "text"), 256).alias("item_id"), F.col("item_id").alias("id"), "text")
    words = own.agg(F.sum(F.length("text") - F.length(F.regexp_replace("text", r"\s+", "")) + 1)).head()[0] or 0
    n = max(1, -(-int(words) // WORDS_A_PASS))
    rows = staged(postings(own), "decontamination-postings") if words else None
    for i in range(n if words else 0):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(n)) == i
        held = own.where(mine).collect()
        yield Index(rows.where(mine).collect(), {r["item_id"]: r["text"] for r in held}, {r["item_id"]: r["id"] for r in held})


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, bm25 (1: the whole of a segment), question_overlap, answer_overlap, of verified matches only."""
    schema = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double"
    own = texts(docs, id_col, text_col)

    def with_index(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = TermIds(index.term)
            for batch in batches:
                for part in slices(batch):
                    found = matches(part.column("text").to_pylist(), index, ids)
                    rows = [(i, *m) for i, own_ in zip(part.column("doc_id").to_pylist(), found, strict=True) for m in own_]
                    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 3)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        return own.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for index in passes(items):
        out = out.unionAll(with_index(index))
    return out.distinct()


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text holds no item; rows don't move."""
    on_workers(docs.sparkSession)

    def with_index(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = TermIds(index.term)
            for batch in batches:
                for part in slices(batch):
                    found = matches(part.column("text").to_pylist(), index, ids)
                    yield part.filter(pa.array([not m for m in found], pa.bool_()))

        return run

    for index in passes(items):
        docs = docs.mapInArrow(with_index(index), docs.schema)
    return docs
