"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. A passage is encoded by itself alone: how often each kind of character
follows each other kind, and figures of its words (how many, how long, how many different, said twice in a row).
A hidden layer gives the representation h of every passage; gated attention weighs the passages of a document,

    a = softmax over the passages of  w . (tanh(V h) * sigmoid(U h))

and the score is sigmoid(c . sum(a h) + d), learned from document labels only by gradient descent through the whole.

Fitted on at most TRAIN_DOCS labelled documents, those first by a hash of their id; fitting and scoring read every passage
of a document. Labels, lang, source and doc_id are no inputs.

Null and empty texts are a bag of one empty passage and get the score the model gives it. Without both kinds of labels
to learn from every score is the share of label 1, or 0.5. Every input row gives a row, repeated ids too; of several texts
under one labelled id the least one is learned from. A very long text is one bag: a task holds its passages, 2 KB each.
Rows with equal texts get equal scores; where documents tie for the sample, the smaller id goes first. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._jobs import texts
from .bpe import slices

PASSAGE = 512
TRAIN_DOCS = 6000
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 12, 64, 4e-3, 1e-4
#: Few documents are gone through more often, to so many steps.
LEAST_STEPS = 800
SEED = 11
#: Bytes of text encoded at once.
SLICE = 1 << 20

KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", ":;", "|", "#*$%&<>", "\"'()[]{}", "-_/\\@+=~^`")
N = 16
FEATURES = N * N + 4
#: Bytes of encoded documents that fitting keeps; those beyond are encoded anew when they are looked at.
KEPT = 256 << 20


def kinds() -> np.ndarray:
    table = np.full(256, N - 1, np.int64)
    for k, chars in enumerate(KINDS):
        table[[ord(c) for c in chars]] = k
    table[0xC0:], table[0x80:0xC0] = N - 3, N - 2
    return table


TABLE = kinds()


def figures(passage: bytes) -> tuple[float, float, float, float]:
    words = passage.split()
    n = max(1, len(words))
    return np.log1p(len(words)) / 8, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(passage) / n / 16


def encoded(texts_: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and passages of each text."""
    data = [(t or "").encode() for t in texts_]
    sizes = np.array([len(d) for d in data])
    n = np.maximum(1, -(-sizes // PASSAGE))
    flat = TABLE[np.frombuffer(b"".join(data), np.uint8)]
    first = np.cumsum(n) - n
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(first, sizes) + offset // PASSAGE
    counts = np.zeros(int(n.sum()) * N * N)
    if len(flat) > 1:
        same = passage[1:] == passage[:-1]
        counts = np.bincount((passage[:-1] * N * N + flat[:-1] * N + flat[1:])[same], minlength=len(counts))
    counts = counts.astype(np.float32).reshape(-1, N * N)
    shares = counts / np.maximum(1, counts.sum(1, keepdims=True))
    own = np.array([figures(d[at : at + PASSAGE]) for d in data for at in range(0, max(1, len(d)), PASSAGE)], np.float32)
    return np.concatenate([np.sqrt(shares), own], 1).astype(np.float32), n


class Model:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        shape = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "ed" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.constant: float | None = None

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        g = (t * s) @ p["w"]
        a = np.exp(g - np.repeat(np.maximum.reduceat(g, at), n))
        a /= np.repeat(np.add.reduceat(a, at), n)
        z = np.add.reduceat(h * a[:, None], at, 0)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def gradient(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f = self.p, self.forward(x, n)
        out = (f["y"] - label) / len(label)
        dz = out[:, None] * p["c"]
        each = np.repeat(dz, n, 0)
        da = (each * f["h"]).sum(1)
        dg = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, np.cumsum(n) - n), n))
        dt, ds = dg[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), dg[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = each * f["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        return {"E": x.T @ de, "e": de.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dg, "c": f["z"].T @ out, "d": out.sum(keepdims=True)}

    def fit(self, texts_: list[str | None], label: np.ndarray) -> Model:
        if len(label) == 0 or label.min() == label.max():
            self.constant = float(label.mean()) if len(label) else 0.5
            return self
        kept: dict[int, np.ndarray] = {}
        size = 0

        def bags(which: np.ndarray) -> list[np.ndarray]:
            nonlocal size
            new = [d for d in which.tolist() if d not in kept]
            found: dict[int, np.ndarray] = {}
            if new:
                x, n = encoded([texts_[d] for d in new])
                found = dict(zip(new, np.split(x, np.cumsum(n)[:-1]), strict=True))
            for d, bag in found.items():
                if size < KEPT:
                    kept[d] = bag.copy()
                    size += bag.nbytes
            return [kept[d] if d in kept else found[d] for d in which.tolist()]

        rng = np.random.default_rng(SEED)
        mean, square, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(label) // BATCH)))
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                mine = bags(own)
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, g in self.gradient(np.concatenate(mine), np.array([len(x) for x in mine]), label[own]).items():
                    g = g + DECAY * self.p[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.full(len(n), self.constant) if self.constant is not None else self.forward(x, n)["y"].astype(np.float64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list:
    """At most ``most`` (text, label) rows outside the held-out fifth, first by a hash of the id."""
    own = texts(docs).where("doc_id is not null")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # known is bounded by most; of several texts under one id the least one counts.
    return own.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sorted(labelled_sample(docs, labels, "quality", TRAIN_DOCS), key=lambda r: r["doc_id"])
    return Model().fit([r["text"] for r in rows], np.array([r["label"] for r in rows], np.float32))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, best_passage (the one with most attention) and its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                x, n = encoded(part.column("text").to_pylist())
                at = np.cumsum(n) - n
                weight = model.forward(x, n)["a"]
                most = np.maximum.reduceat(weight, at)
                which = [int(np.argmax(weight[a : a + k])) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x, n)), pa.array(which, pa.int32()), pa.array(most.astype(np.float64))], names=["doc_id", "score", "best_passage", "weight"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, best_passage int, weight double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all their columns, with a score of at least ``least``; rows don't move."""
    texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                yield part.filter(pa.array(model.score(*encoded(part.column("text").to_pylist())) >= least))

    return docs.mapInArrow(run, docs.schema)
