"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find grouping.

Words are runs of visible ASCII-blank-separated characters, A-Z lower-cased; a document's set is its distinct 5-word
shingles, or its whole sequence if it has fewer words. A node is a word sequence, whatever rows hold it. A signature has
BANDS * ROWS places. SuperMinHash deals each element a random permutation of the places: its j-th draw puts j plus a
fraction on the j-th place of its permutation, so draws of a later round can't beat those of an earlier one, and a
document stops with the first round that leaves no place empty. Two sets with similarity s agree on a place with
probability s; at 0.85 a pair shares no band with probability 2e-8.

Candidates are not paired up within a bucket. Every node of a bucket is joined to the bucket's smallest node, and the
components of these joins are families: nodes that share a bucket are in one family. A family's full sets go to one task,
which walks from node to linked node; each step compares one node with all that no walk has reached yet, so a family
of many linked nodes costs few comparisons. A family with more than FAMILY shingles is compared by joins instead: every
node with the smallest of each of its buckets, then nodes of one bucket that are still in different components.

    null or empty text    no shingles, linked with nothing, component is its own id
    null id               never linked; component null, kept
    an id on several rows each row goes by its own text; the texts of one id are reached from each other, which counts for
                          component_id but makes no near-duplicates: ``deduplicated`` keeps a row of every group of texts
    very long texts       a task holds a few megabytes of texts, or one longer text with 8 bytes for each of its words
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ._jobs import discard, plain_names, staged, texts
from .bpe import slices

SHINGLE = 5
PERCENT = 85
ROWS = 4
BANDS = 24
#: Shingles of a family that one task compares.
FAMILY = 4_000_000
#: Words whose hashes a worker remembers; a full table is emptied.
WORDS_HELD = 200_000

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    """The finishing step of the splitmix generator."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def shingle_sets(word_lists: list[list[bytes]]) -> list[np.ndarray]:
    """Sorted distinct hashes of each list's shingles."""
    if len(WORDS) > WORDS_HELD:
        WORDS.clear()
    counts = np.array([len(w) for w in word_lists])
    flat = np.fromiter(map(WORDS.__getitem__, chain.from_iterable(word_lists)), U, int(counts.sum()))
    n = max(0, len(flat) - SHINGLE + 1)
    runs = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            runs = runs * U(0xD6E8FEB86659FD93) + flat[k : k + n]
    runs = mixed(runs)
    out, at = [], 0
    for words, count in zip(word_lists, counts.tolist(), strict=True):
        if count >= SHINGLE:
            out.append(np.unique(runs[at : at + count - SHINGLE + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], U) if words else np.zeros(0, U))
        at += count
    return out


def signatures(sets: list[np.ndarray], places: int = ROWS * BANDS) -> np.ndarray:
    """One row of places for each set; inf throughout for an empty one."""
    register = np.full((len(sets), places), np.inf)
    element = np.concatenate([*sets, np.zeros(0, U)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for j in range(places):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            drawn = mixed(element + GOLDEN * U(2 * j + 1))
            choice = mixed(element + GOLDEN * U(2 * j + 2))
        k = j + (choice % U(places - j)).astype(np.int64)
        # What stands at k after the earlier exchanges of a shuffle that began with place i at i.
        place = k.copy()
        for i in range(j - 1, -1, -1):
            place = np.where(place == i, swaps[i], np.where(place == swaps[i], i, place))
        np.minimum.at(register, (owner, place), j + (drawn >> U(11)).astype(np.float64) * 2.0**-53)
        swaps.append(k)
        going = np.isinf(register).any(1)[owner]
        if not going.all():
            element, owner, swaps = element[going], owner[going], [s[going] for s in swaps]
    return register


def band_keys(register: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bits = register.view(U).reshape(len(register), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * GOLDEN, bits.shape[:2])
    for r in range(ROWS):
        key = mixed(key ^ bits[:, :, r])
    return key.view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # on bytes: ASCII letters, ASCII blanks


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, tail (a hash of the text that tells rows of one id apart), key (of the word sequence), n_shingles, bands (null
    without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            words = [words_of(x) for x in part.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            sets = shingle_sets(words)
            sizes = np.array([len(s) for s in sets], np.int64)
            bands = band_keys(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tail"), pa.array(keys, pa.binary()), pa.array(sizes), pa.array([b if n else None for b, n in zip(bands, sizes, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "tail", "key", "n_shingles", "bands"],
            )

    return tailed(docs).mapInArrow(run, "doc_id long, tail long, key binary, n_shingles long, bands array<long>")


def tailed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tail"), "text")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of nodes wanted (doc_id, tail and more columns); a sort-merge join at every size."""
    return tailed(docs).join(wanted.hint("merge"), ["doc_id", "tail"])


def full_sets(docs: DataFrame) -> DataFrame:
    """node, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            sets = shingle_sets([words_of(x) for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node binary, shingles array<long>")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough. Only documents of a pair move, once for each side."""
    wanted = pairs.select(F.col("x").alias("node")).unionAll(pairs.select(F.col("y").alias("node"))).distinct()
    sets = staged(full_sets(texts_of(docs, nodes.join(wanted, "node", "left_semi").select("node", "first.*"))), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x")
    both = both.join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    return staged(both.where(100 * common >= PERCENT * (F.size("sx") + F.size("sy") - common)).select("x", "y").distinct(), "near-links")


def alike_in_size(n: str, m: str) -> F.Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


class Postings:
    """Of some sets (by number), which hold a token among the rarest that a similar set would have to share.

    Similar sets of n tokens share PERCENT of n at least, so of the n - PERCENT of n + 1 rarest tokens of each, one is shared.
    """

    def __init__(self, own: list[np.ndarray], sizes: np.ndarray, rarity: np.ndarray, which: np.ndarray):
        flat, _ = laid_out(own, sizes, which)
        n = sizes[which]
        owner = np.repeat(np.arange(len(which)), n)
        order = np.lexsort((flat, rarity[flat], owner))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        few = place < np.repeat(n - -(-PERCENT * n // 100) + 1, n)
        self.rare, self.ends = flat[order][few], np.cumsum(np.bincount(owner[few], minlength=len(which)))
        self.at = {int(i): k for k, i in enumerate(which.tolist())}
        by_token = np.argsort(self.rare, kind="stable")
        self.token, self.holder = self.rare[by_token], which[owner[few][by_token]]

    def sharing(self, tokens: np.ndarray, sets: int) -> np.ndarray:
        """Which of so many sets hold one of the tokens."""
        lo, hi = np.searchsorted(self.token, tokens, "left"), np.searchsorted(self.token, tokens, "right")
        lists = [self.holder[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
        if 8 * int((hi - lo).sum()) < sets:
            return np.unique(np.concatenate(lists)) if lists else lo[:0]
        hit = np.zeros(sets, bool)
        for x in lists:
            hit[x] = True
        return np.flatnonzero(hit)

    def rarest(self, i: int) -> np.ndarray:
        k = self.at[i]
        return self.rare[self.ends[k - 1] if k else 0 : self.ends[k]]


def walked(nodes: list[bytes], sets: list[np.ndarray]) -> list[bytes]:
    """The smallest node that links lead to, for each node of a family. A node is compared with those only that share one of
    its rarest tokens and are of its size; the postings shrink with what is left."""
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    own = np.split(token, np.cumsum(sizes)[:-1])
    rarity = np.bincount(token)
    component = np.arange(len(nodes))
    mark, open_ = np.zeros(len(rarity), bool), np.ones(len(nodes), bool)
    which = np.arange(len(nodes))
    postings, (flat, starts) = Postings(own, sizes, rarity, which), laid_out(own, sizes, which)
    rarest = [postings.rarest(i) for i in range(len(nodes))]
    left = len(nodes)
    for root in range(len(nodes)):  # in order of node, so that each walk starts at its smallest
        if not open_[root]:
            continue
        open_[root], left, queue = False, left - 1, [root]
        while queue and left:
            if 2 * left < len(which):
                which = np.flatnonzero(open_)
                postings, (flat, starts) = Postings(own, sizes, rarity, which), laid_out(own, sizes, which)
            at = queue.pop()
            near = postings.sharing(rarest[at], len(nodes))
            n = sizes[near]
            near = near[open_[near] & (100 * np.minimum(n, sizes[at]) >= PERCENT * np.maximum(n, sizes[at]))]
            if not len(near):
                continue
            mark[own[at]] = True
            if 4 * len(near) > len(which):  # nearly all: their layout is there already
                common = np.add.reduceat(mark[flat].astype(np.int64), starts)[np.searchsorted(which, near)]
            else:
                some, begin = laid_out(own, sizes, near)
                common = np.add.reduceat(mark[some].astype(np.int64), begin)
            mark[own[at]] = False
            near = near[100 * common >= PERCENT * (sizes[at] + sizes[near] - common)]
            component[near], open_[near], left = root, False, left - len(near)
            queue += near.tolist()
    return [nodes[i] for i in component]


def laid_out(own: list[np.ndarray], sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([own[i] for i in which]), np.cumsum(sizes[which]) - sizes[which]


def within_families(docs: DataFrame, families: DataFrame) -> DataFrame:
    """node, component, of families (node, family, doc_id, tail): one text shuffle, then one of the sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            found = shingle_sets([words_of(x) for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("family"), part.column("node"), pa.array([x.tobytes() for x in found], pa.binary())], names=["family", "node", "shingles"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, nodes, held = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(walked(nodes, held), pa.binary())], names=["node", "component"])

        for batch in batches:
            for f, node, raw in zip(*[batch.column(c).to_pylist() for c in ("family", "node", "shingles")], strict=True):
                if f != family and nodes:
                    yield out()
                    nodes, held = [], []
                if not nodes or node != nodes[-1]:  # a row that stands twice has its node once
                    family = f
                    nodes.append(node)
                    held.append(np.frombuffer(raw, U))
        if nodes:
            yield out()

    rows = texts_of(docs, families).select("family", "node", "text").mapInArrow(sets, "family binary, node binary, shingles binary")
    return rows.repartition("family").sortWithinPartitions("family", "node").mapInArrow(walk, "node binary, component binary")


def by_joins(docs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component, of nodes whose families are too large for a task (members: node, n, bucket)."""
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).where("hub.node < last")
    near = members.join(hubs, "bucket").select(F.col("node").alias("x"), F.col("hub.node").alias("y"), "n", F.col("hub.n").alias("m"))
    pairs = staged(near.where(F.col("x") != F.col("y")).where(alike_in_size("n", "m")).select("x", "y").distinct(), "near-pairs")
    links = verified(pairs, docs, nodes)
    found = staged(components(links.select(F.col("x").alias("src"), F.col("y").alias("dst"))), "near-components")
    placed = members.join(found.withColumnRenamed("component", "c"), "node", "left").select("bucket", "node", "n", F.coalesce("c", "node").alias("c"))
    mixed_buckets = placed.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("bucket")
    open_ = staged(placed.join(mixed_buckets, "bucket", "left_semi"), "near-open")
    left = open_.select("bucket", F.col("node").alias("x"), F.col("n"), F.col("c").alias("cx"))
    right = open_.select("bucket", F.col("node").alias("y"), F.col("n").alias("m"), F.col("c").alias("cy"))
    rest = left.join(right, "bucket").where("cx < cy").where(alike_in_size("n", "m")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    rest = staged(rest.join(pairs, ["x", "y"], "left_anti"), "near-pairs")
    more = verified(rest, docs, nodes)
    edges = found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionAll(more.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    return components(edges)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", family: int = FAMILY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, tail, stands (the row, or one of several with its id and text, that stands for
    its group of texts)."""
    own = texts(docs, id_col, text_col)
    rows = staged(signed(own), "near-signed")
    nodes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("key").alias("node"))
    nodes = staged(nodes.agg(F.min(F.struct("doc_id", "tail")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("bucket", "hub")
    joins = members.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst")).distinct()
    families = staged(components(joins).withColumnRenamed("component", "family"), "near-families")
    weight = nodes.select("node", "n").join(families, "node").groupBy("family").agg(F.sum("n").alias("total"))
    large = staged(weight.where(F.col("total") > family).select("family"), "near-large")
    small = families.join(large, "family", "left_anti").join(nodes.select("node", "first"), "node").select("node", "family", "first.*")
    found = within_families(own, small)
    if not large.isEmpty():
        mine = families.join(large, "family", "left_semi").select("node")
        found = found.unionAll(by_joins(own, members.join(mine, "node", "left_semi"), nodes))
    found = staged(found, "near-components")

    named = nodes.select("node").join(found, "node", "left").select(F.col("node").alias("key"), F.coalesce("component", "node").alias("c"))
    known = rows.select("doc_id", "tail", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"), "n_shingles")
    placed = staged(known.join(named, "key", "left").drop("key"), "near-placed")
    # The texts of one id reach each other.
    several = placed.where("c is not null and doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("dst"), F.max("c").alias("last")).where("dst < last").select("doc_id", "dst")
    edges = placed.join(several, "doc_id").where("c <> dst").select(F.col("c").alias("src"), "dst")
    over = staged(components(edges), "near-over")
    groups = placed.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "tail")).alias("first"))
    groups = staged(groups.join(over.withColumnRenamed("node", "c"), "c", "left").select("c", "first", F.coalesce("component", "c").alias("component")), "near-groups")
    least = groups.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    out = placed.join(staged(groups.join(least, "component").select("c", "first", "component_id"), "near-named"), "c", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    stands = F.coalesce(F.struct("doc_id", "tail") == F.col("first"), F.lit(True))
    discard(nodes, families, large, found, over, groups)
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "tail", stands.alias("stands"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "tail", "stands")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group of texts; rows repeated with id and text stay together."""
    kept = grouped(docs).where("stands").select(F.col("doc_id").alias("__id"), F.col("tail").alias("__tail")).distinct().hint("merge")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__tail"))
    return plain_names(docs).join(kept, same, "left_semi").toDF(*docs.columns)
