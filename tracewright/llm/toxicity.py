"""Toxicity by votes of the nearest labelled examples.

Examples and documents are TF-IDF vectors over all terms of the examples: every word, and beginnings of words that depend on
the label by chi-square (an inflected word then meets its stem). A term's weight is (1 + log tf) * idf * strength; strength
is FLOOR, plus the correlation of the term with label 1 among the examples where that is significant. So no word is left
out, and words that tell the label decide who is near. Similarity is the exact cosine.

The examples stand in an inverted index with blocks of BLOCK of them: each term's postings, and the largest weight of each
(term, block). Common terms' shares of the similarity are worked out for all examples at once; with these a document's
weights and the maxima of its other terms bound every block. The FIRST most promising blocks are opened, then all that may
still hold one of the K nearest, so that the K found are the K nearest. They vote with their similarity
squared. A vote becomes a score by the share of toxic examples among those with a like vote when each example is left out
of its own vote (pooled so that scores rise with votes).

The examples are at most EXAMPLES labelled documents, first by a hash of their id, near copies once. Labels, lang, source
and doc_id are no inputs of a score. Null and empty texts, and texts without any word of the examples, get the share among
such examples, or else among all. Without both labels to learn from every score is the share of label 1, or 0. Every
input row gives a row, repeated ids too; ties go to the earlier example. A very long text costs what its different words
have postings; it is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._jobs import texts
from .bpe import slices
from .decontamination import spread
from .quality_model import labelled_sample

EXAMPLES = 4000
#: Strength of a term that says nothing of the label, and chi-square from which a term says something (one in a thousand).
FLOOR = 0.01
SIGNIFICANT = 10.83
#: Beginnings of words that can be terms.
STEMS = (4, 5, 6)
STEM = "^"
BLOCK = 64
FIRST = 4
#: A term in one of so many examples or more is common; and documents whose common terms are looked up together.
COMMON = 64
TOGETHER = 256
K = 15
BINS = 24
WORDS_HELD = 400_000
#: Similarity of the shingle sets of near copies.
COPY = 0.8

EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def bare(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else EDGE.sub("", word)


def forms(word: str) -> list[str]:
    """What a word may stand for: itself and its beginnings."""
    return [word, *(STEM + word[:k] for k in STEMS if k < len(word))] if word else []


def shingles(words: list[str]) -> frozenset[int]:
    """Hashes of five neighbouring words; a shorter text is one."""
    return frozenset(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4)))


def without_copies(rows: list) -> list:
    """The first of the rows that are near copies of each other with one label, so that words of a much copied text count
    once. Rows that share their smallest shingle are compared on whole sets; a common footer alone makes no copy."""
    kept: list = []
    near: dict[tuple[int, int], list[frozenset[int]]] = {}
    for r in rows:
        own = shingles((r["text"] or "").split())
        others = near.setdefault((min(own), r["label"]), [])
        if not any(len(own & o) >= COPY * (len(own) + len(o) - len(own & o)) for o in others):
            others.append(own)
            kept.append(r)
    return kept


class Examples:
    """The inverted index of the examples, and the calibration of their votes."""

    def __init__(self, rows: list):
        rows = without_copies(rows)
        label = np.array([r["label"] for r in rows], float)
        self.base = float(label.mean()) if len(label) else 0.0
        self.term: dict[str, int] = {}
        self.label = label[:0]
        if not len(label) or label.min() == label.max():
            return
        every = FormIds()
        counts = [np.unique(every.of(r["text"]), return_counts=True) for r in rows]
        n, n1 = len(label), label.sum()
        names = every.names()
        owner = np.repeat(label, [len(t) for t, _ in counts])
        seen = np.concatenate([t for t, _ in counts])
        k, a = np.bincount(seen, minlength=len(names)).astype(float), np.bincount(seen, owner, len(names))
        above = a * n - k * n1
        chi = np.where((above > 0) & (k < n), n * above**2 / np.maximum(k * (n - k) * n1 * (n - n1), 1), 0.0)
        keep = np.flatnonzero((chi >= SIGNIFICANT) | np.array([not t.startswith(STEM) for t in names], bool))
        strength = (FLOOR + np.where(chi >= SIGNIFICANT, np.sqrt(chi / n), 0.0)) * (np.log((1 + n) / (1 + k)) + 1)
        self.term = {names[i]: at for at, i in enumerate(keep.tolist())}
        self.strength = strength[keep]
        place = np.full(len(names), -1)
        place[keep] = np.arange(len(keep))

        vectors = [self.vector(place[t][place[t] >= 0], c[place[t] >= 0].astype(float)) for t, c in counts]
        some = np.flatnonzero([len(t) > 0 for t, _ in vectors])
        none = np.setdiff1d(np.arange(n), some)
        self.base = float(label[none].mean()) if len(none) else self.base
        heaviest = np.array([t[np.argmax(w)] for t, w in (vectors[i] for i in some)], np.int64)
        some = some[np.lexsort((some, heaviest))]  # like examples share a block
        self.label, self.ids = label[some], np.array([rows[i]["doc_id"] for i in some])
        if len(some):
            self.indexed([vectors[i] for i in some])
            self.calibrate([vectors[i] for i in some])

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights."""
        weight = (1 + np.log(tf)) * self.strength[terms]
        return terms, weight / max(float(np.sqrt((weight * weight).sum())), 1e-12)

    def indexed(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings by (term, example); entries by (term, block) with their largest weight and where their postings begin."""
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors])
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], np.concatenate([w for _, w in vectors])[order]
        block = self.example // BLOCK
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        self.block, self.most = block[new], np.maximum.reduceat(self.weight, new)
        self.postings = np.r_[new, len(term)]
        self.entries = np.searchsorted(term[new], np.arange(len(self.term) + 1))
        self.lists = self.postings[self.entries]
        self.blocks = -(-len(vectors) // BLOCK)
        self.block_of = np.arange(len(vectors)) // BLOCK
        self.common = np.flatnonzero(np.diff(self.lists) * COMMON >= len(vectors))
        self.slot = np.full(len(self.term), -1)
        self.slot[self.common] = np.arange(len(self.common))

    def opened(self) -> Examples:
        """With rows of all examples for common terms; they are made anew in each task, not sent there."""
        self.dense = np.zeros((len(self.common), len(self.label)))
        for i, t in enumerate(self.common.tolist()):
            own = slice(self.lists[t], self.lists[t + 1])
            self.dense[i, self.example[own]] = self.weight[own]
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "dense"}

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector similarities and places of the k nearest examples, in falling order; ties go to the earlier place.
        The shares of common terms are exact for all examples; the other terms' postings are read where the bounds ask."""
        out = []
        for i in range(0, len(vectors), TOGETHER):
            part = vectors[i : i + TOGETHER]
            q = np.zeros((len(part), len(self.common)))
            slots = [self.slot[terms] for terms, _ in part]
            for r, ((_, weight), slot) in enumerate(zip(part, slots, strict=True)):
                q[r, slot[slot >= 0]] = weight[slot >= 0]
            known = q @ self.dense
            out += [self.closest(known[r], terms[slot < 0], weight[slot < 0], k) for r, ((terms, weight), slot) in enumerate(zip(part, slots, strict=True))]
        return out

    def closest(self, known: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        row, entry = spread(self.entries, terms)
        share = weight[row]
        bound = np.maximum.reduceat(known, np.arange(self.blocks) * BLOCK) + np.bincount(self.block[entry], share * self.most[entry], self.blocks)
        similar = np.full(len(self.label), -1.0)
        done = np.zeros(self.blocks, bool)
        for wanted in (np.argsort(-bound, kind="stable")[:FIRST], None):
            if wanted is None:
                least = np.partition(similar, -k)[-k]
                wanted = np.flatnonzero(~done & (bound >= least - 1e-9))
            now = np.zeros(self.blocks, bool)
            now[wanted] = True
            done |= now
            mine = now[self.block[entry]]
            which, at = spread(self.postings, entry[mine])
            found = known + np.bincount(self.example[at], share[mine][which] * self.weight[at], len(self.label))
            inside = now[self.block_of]
            similar[inside] = np.round(found[inside], 12)
        least = np.partition(similar, -k)[-k]
        place = np.flatnonzero(similar >= least)
        place = place[np.lexsort((place, -similar[place]))][:k]
        return similar[place], place

    def vote(self, similar: np.ndarray, place: np.ndarray) -> float:
        weight = np.maximum(similar, 0) ** 2
        return float((weight * self.label[place]).sum() / max(weight.sum(), 1e-12))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Shares by vote, made to rise: neighbouring bins that fall are pooled."""
        votes = []
        for i, (similar, place) in enumerate(self.opened().nearest(vectors, min(K + 1, len(vectors)))):
            others = place != i
            votes.append(self.vote(similar[others][:K], place[others][:K]))
        vote = np.array(votes)
        order = np.argsort(vote, kind="stable")
        merged: list[list[float]] = []
        starts = np.linspace(0, len(order), min(BINS, len(order)), endpoint=False).astype(int)
        ordered = vote[order]
        for own in np.split(order, np.unique(np.searchsorted(ordered, ordered[starts]))[1:]):  # like votes stay together
            merged.append([vote[own].sum(), self.label[own].sum() + self.label.mean(), len(own) + 1.0, len(own)])
            while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
                last = merged.pop()
                merged[-1] = [a + b for a, b in zip(merged[-1], last, strict=True)]
        self.curve = np.array([m[0] / m[3] for m in merged]), np.array([m[1] / m[2] for m in merged])

    def judge(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Score, and the nearest examples' ids as evidence, of each document's counted terms."""
        some = [i for i, (terms, _) in enumerate(counted) if len(terms) and len(self.label)]
        out: list[tuple[float, list[int]]] = [(self.base, [])] * len(counted)
        for i, (similar, place) in zip(some, self.nearest([self.vector(*counted[i]) for i in some], min(K, len(self.label))), strict=True):
            out[i] = float(np.clip(np.interp(self.vote(similar, place), *self.curve), 0, 1)), self.ids[place[:3]].tolist()
        return out


class WordTerms(dict):
    """Terms of a raw word."""

    def __init__(self, term: dict[str, int]):
        self.term = term

    def __missing__(self, raw: str) -> tuple[int, ...]:
        self[raw] = found = tuple(self.term[f] for f in forms(bare(raw)) if f in self.term)
        return found

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, (text or "").split())), np.int64)


class FormIds(WordTerms):
    """All forms of a raw word, numbered as they come."""

    def __init__(self) -> None:
        super().__init__({})

    def __missing__(self, raw: str) -> tuple[int, ...]:
        self[raw] = found = tuple(self.term.setdefault(f, len(self.term)) for f in forms(bare(raw)))
        return found

    def names(self) -> list[str]:
        return list(self.term)


def trained(docs: DataFrame, labels: DataFrame) -> Examples:
    return Examples(sorted(labelled_sample(docs, labels, "toxic", EXAMPLES), key=lambda r: r["doc_id"]))


def scored(docs: DataFrame, examples: Examples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence (ids of the three nearest examples; empty without a word of the index)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTerms(examples.term)
        opened = examples.opened() if len(examples.label) else examples
        for batch in batches:
            for part in slices(batch):
                if len(known) > WORDS_HELD:
                    known.clear()
                counted = [np.unique(known.of(text), return_counts=True) for text in part.column("text").to_pylist()]
                score, evidence = zip(*opened.judge([(terms, tf.astype(float)) for terms, tf in counted]), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<long>")
