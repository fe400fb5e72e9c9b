"""Which nodes of a graph come before which, from an index in place of the closure.

The graph is cut into chains, and a node is a place on its chain. What a chain has seen of another is kept only where it
changes: a row (chain, at, other, upto) says that from place ``at`` on, all places of the other chain up to ``upto`` come
before. A linear history of any length is one chain without a row; a row stands for a merge, not for a pair of nodes.
``repository`` is part of every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.staging import discard, staged

#: A place after all others of a chain.
END = 1 << 60


def ranked(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repository, node, head, pos, low, done) by pointer jumping along links (repository, node, prev): each round doubles
    the distance. Nodes that never find a head lie on cycles; ``low`` is then the smallest node of the cycle."""
    at = nodes.join(links, ["repository", "node"], "left").select("repository", "node", F.coalesce("prev", "node").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.least("node", F.coalesce("prev", "node")).alias("low"), F.col("prev").isNull().alias("done"))
    at = staged(at, "chains")
    total, rounds = at.count(), 0
    while 1 << rounds <= 2 * total:
        jump = at.select("repository", F.col("node").alias("head"), F.col("head").alias("next"), F.col("pos").alias("more"), F.col("low").alias("lower"), F.col("done").alias("found"))
        left = at.where("not done").join(jump, ["repository", "head"])
        moved = left.select("repository", "node", F.col("next").alias("head"), (F.col("pos") + F.col("more")).alias("pos"), F.least("low", "lower").alias("low"), F.col("found").alias("done"))
        new = staged(at.where("done").unionAll(moved), "chains")
        discard(at)
        at, rounds = new, rounds + 1
        if at.where("not done").isEmpty():
            break
    return at


def chains(edges: DataFrame) -> DataFrame:
    """(repository, node, chain, pos) of every node of (repository, node, parent).

    Each node asks its smallest parent to go on with it, each parent goes on with the smallest that asks. Cycles are cut
    before their smallest node.
    """
    nodes = staged(edges.select("repository", "node").unionAll(edges.select("repository", F.col("parent").alias("node"))).distinct(), "nodes")
    asked = edges.where("node <> parent").groupBy("repository", "node").agg(F.min("parent").alias("prev"))
    links = staged(asked.groupBy("repository", "prev").agg(F.min("node").alias("node")), "links")
    at = ranked(links, nodes)
    looped = at.where("not done")
    if not looped.isEmpty():
        # Before the cut, every node of a cycle knows the smallest.
        cut = links.join(looped.where("node = low").select("repository", "node"), ["repository", "node"], "left_anti")
        again = ranked(cut.join(looped.select("repository", "node"), ["repository", "node"], "left_semi"), looped.select("repository", "node"))
        at = at.where("done").unionAll(again)
    return at.select("repository", "node", F.col("head").alias("chain"), "pos")


def spread(steps: DataFrame) -> DataFrame:
    """The rows (repository, chain, at, other, upto) that follow from single steps of this form, without those that an
    earlier or equal place implies. Paths double with each round."""
    same = F.col("chain") == F.col("other")

    def least(rows: DataFrame) -> DataFrame:
        best = rows.where(~same | (F.col("upto") >= F.col("at"))).groupBy("repository", "chain", "at", "other").agg(F.max("upto").alias("upto"))
        w = W.partitionBy("repository", "chain", "other").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        return best.withColumn("known", F.max("upto").over(w)).where("known is null or known < upto").drop("known")

    seen = staged(least(steps), "reach")
    state = None
    while True:
        now = seen.agg(F.count(F.lit(1)), F.sum(F.col("upto") % 1_000_003), F.sum(F.hash("repository", "chain", "at", "other", "upto").cast("long"))).head()
        if now == state:
            return seen
        state = now
        further = seen.select("repository", F.col("chain").alias("other"), F.col("at").alias("from"), F.col("other").alias("third"), F.col("upto").alias("reached"))
        longer = seen.join(further, ["repository", "other"]).where(F.col("from") <= F.col("upto")).select("repository", "chain", "at", F.col("third").alias("other"), F.col("reached").alias("upto"))
        new = staged(least(seen.unionAll(longer)), "reach")
        discard(seen)
        seen = new


def crossing(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Steps between chains of the edges (repository, node, parent)."""
    child = places.select("repository", "node", "chain", F.col("pos").alias("at"))
    parent = places.select("repository", F.col("node").alias("parent"), F.col("chain").alias("other"), F.col("pos").alias("upto"))
    j = edges.select("repository", "node", "parent").join(child, ["repository", "node"]).join(parent, ["repository", "parent"])
    return j.where("chain <> other or upto >= at").select("repository", "chain", "at", "other", "upto")


class Index:
    """places: repository, node, chain, pos; seen: repository, chain, at, other, upto."""

    def __init__(self, edges: DataFrame):
        edges = staged(edges.select("repository", "node", "parent").where("node is not null and parent is not null").distinct(), "edges")
        self.places = staged(chains(edges), "places")
        self.seen = spread(crossing(edges, self.places))

    def ancestors(self, nodes: DataFrame) -> DataFrame:
        """(repository, node, ancestor) of the nodes asked for (repository, node)."""
        own = nodes.join(self.places, ["repository", "node"])
        direct = own.select("repository", "node", F.col("chain").alias("other"), (F.col("pos") - 1).alias("upto"))
        across = own.join(self.seen, ["repository", "chain"]).where("at <= pos").select("repository", "node", "other", "upto")
        upto = direct.unionAll(across).groupBy("repository", "node", "other").agg(F.max("upto").alias("upto"))
        found = self.places.select("repository", F.col("chain").alias("other"), "pos", F.col("node").alias("ancestor"))
        return upto.where("upto >= 0").join(found, ["repository", "other"]).where("pos <= upto").select("repository", "node", "ancestor")

    def ancestor_counts(self, nodes: DataFrame) -> DataFrame:
        """(repository, node, ancestors): how many there are, from the index alone."""
        own = nodes.join(self.places, ["repository", "node"])
        direct = own.select("repository", "node", F.col("chain").alias("other"), (F.col("pos") - 1).alias("upto"))
        across = own.join(self.seen, ["repository", "chain"]).where("at <= pos").select("repository", "node", "other", "upto")
        upto = direct.unionAll(across).groupBy("repository", "node", "other").agg(F.max("upto").alias("upto"))
        return upto.groupBy("repository", "node").agg(F.sum(F.col("upto") + 1).alias("ancestors"))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """verdict of commits (repository, a, b): same, before, after, unordered, or unknown if one isn't a known node. Two
        that come before each other, on a cycle, are unordered."""
        side = lambda x: self.places.select("repository", F.col("node").alias(x), F.col("chain").alias(f"c{x}"), F.col("pos").alias(f"p{x}"))
        j = pairs.join(side("a"), ["repository", "a"], "left").join(side("b"), ["repository", "b"], "left")
        for x, y in ("ab", "ba"):
            s = self.seen.select("repository", F.col("chain").alias(f"c{y}"), F.col("other").alias(f"c{x}"), "at", "upto")
            found = j.select("repository", "a", "b", "ca", "cb", "pa", "pb").distinct().join(s, ["repository", f"c{x}", f"c{y}"]).where((F.col("at") <= F.col(f"p{y}")) & (F.col("upto") >= F.col(f"p{x}")))
            j = j.join(found.select("repository", "a", "b", F.lit(True).alias(x + y)).distinct(), ["repository", "a", "b"], "left")
            j = j.withColumn(x + y, F.coalesce(x + y, F.lit(False)) | F.coalesce((F.col("ca") == F.col("cb")) & (F.col(f"p{x}") < F.col(f"p{y}")), F.lit(False)))
        verdict = F.when(F.col("ca").isNull() | F.col("cb").isNull(), "unknown").when(F.col("a") == F.col("b"), "same").when(F.col("ab") == F.col("ba"), "unordered").when(F.col("ab"), "before").otherwise("after")
        return j.select("repository", "a", "b", verdict.alias("verdict"))


def on_loops(links: DataFrame) -> DataFrame:
    """(repository, node) of the nodes of (repository, node, prev), one prev each at most, that come back to themselves: after
    as many steps as there are nodes, all that is left are nodes of loops."""
    nodes = links.select("repository", "node").unionAll(links.select("repository", F.col("prev").alias("node"))).distinct()
    at = ranked(links, nodes)
    return at.where("not done").select("repository", F.col("head").alias("node")).distinct()


def event_clocks(observed: DataFrame, commits: DataFrame, links: DataFrame) -> DataFrame:
    """What each session has seen of the others: (submission_id, session_id, at, other, upto): an event of ``other`` up to seq
    ``upto`` comes before all events of the session from seq ``at`` on. END stands for a whole session, -1 for its start.

    observed: submission_id, session_id, seq, repository, sha. commits: submission_id, repository, sha, parent. links: submission_id, session_id,
    prev_session_id. A commit comes before an observation of its strict descendants; seeing one commit twice orders nothing.
    A commit has two places on its chain, before and after it is made.
    """
    graph = F.to_json(F.struct("submission_id", F.col("repository").alias("r")))
    edges = commits.select(graph.alias("repository"), F.col("sha").alias("node"), "parent").where("node is not null and parent is not null").distinct()
    edges = staged(edges, "edges")
    places = staged(chains(edges), "places")
    known = observed.select("submission_id", "session_id", "seq", graph.alias("repository"), F.col("sha").alias("node")).join(places, ["repository", "node"])
    session = lambda c: F.concat(F.lit("session "), F.col(c))
    line = F.concat(F.lit("commits "), F.col("repository"), F.lit(" "), F.col("chain").cast("string"))
    scope = F.col("submission_id").alias("repository")
    made = known.select(scope, line.alias("chain"), (2 * F.col("pos") + 1).alias("at"), session("session_id").alias("other"), F.col("seq").cast("long").alias("upto"))
    met = known.select(scope, session("session_id").alias("chain"), F.col("seq").cast("long").alias("at"), line.alias("other"), (2 * F.col("pos")).alias("upto"))
    own = edges.join(known.select("submission_id", "repository").distinct(), "repository")
    cross = own.join(places.select("repository", "node", "chain", F.col("pos").alias("at")), ["repository", "node"]).join(places.select("repository", F.col("node").alias("parent"), F.col("chain").alias("from"), F.col("pos").alias("upto")), ["repository", "parent"]).where("chain <> from or upto >= at")
    across = cross.select(scope, line.alias("chain"), (2 * F.col("at")).alias("at"), F.concat(F.lit("commits "), F.col("repository"), F.lit(" "), F.col("from").cast("string")).alias("other"), (2 * F.col("upto") + 1).alias("upto"))
    follow = links.where("prev_session_id is not null and prev_session_id <> session_id").select(scope, session("session_id").alias("chain"), F.lit(-1).cast("long").alias("at"), session("prev_session_id").alias("other"), F.lit(END).cast("long").alias("upto"))
    seen = spread(made.unionAll(met).unionAll(across).unionAll(follow))
    name = lambda c: F.substring(c, 9, 1_000_000)
    return seen.where("chain like 'session %' and other like 'session %' and chain <> other").select(F.col("repository").alias("submission_id"), name(F.col("chain")).alias("session_id"), "at", name(F.col("other")).alias("other"), "upto")


def doors(events: DataFrame) -> DataFrame:
    """Events with the seqs of the observations (kind git.event) next to them in their session: ``entry`` at or before, -1 if
    there is none, and ``exit`` at or after, END if there is none; ``window`` counts those before."""
    w = W.partitionBy("submission_id", "session_id").orderBy("seq")
    seen = F.when(F.col("kind") == "git.event", F.col("seq").cast("long"))
    entry = F.coalesce(F.last(seen, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(-1).cast("long"))
    leave = F.coalesce(F.first(seen, True).over(w.rowsBetween(0, W.unboundedFollowing)), F.lit(END).cast("long"))
    window = F.coalesce(F.count(seen).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("entry", entry).withColumn("exit", leave).withColumn("window", window)


def event_order(pairs: DataFrame, events: DataFrame, clocks: DataFrame) -> DataFrame:
    """verdict of event pairs (submission_id, a, b by global_idx): same, before, after, concurrent, or unknown if one of them
    isn't among the events. Each before the other, by records that contradict each other, is concurrent."""
    e = doors(events).select("submission_id", "session_id", "global_idx", "seq", "entry", "exit")
    side = lambda x: e.select("submission_id", F.col("global_idx").alias(x), F.col("session_id").alias(f"s{x}"), F.col("seq").alias(f"q{x}"), F.col("entry").alias(f"n{x}"), F.col("exit").alias(f"x{x}"))
    j = pairs.join(side("a"), ["submission_id", "a"], "left").join(side("b"), ["submission_id", "b"], "left")
    for x, y in ("ab", "ba"):
        c = clocks.select("submission_id", F.col("session_id").alias(f"s{y}"), F.col("other").alias(f"s{x}"), "at", "upto")
        hit = j.select("submission_id", "a", "b", "sa", "sb", f"x{x}", f"n{y}").join(c, ["submission_id", "sa", "sb"]).where((F.col("at") <= F.col(f"n{y}")) & (F.col("upto") >= F.col(f"x{x}")))
        j = j.join(hit.select("submission_id", "a", "b", F.lit(True).alias(x + y)).distinct(), ["submission_id", "a", "b"], "left")
    verdict = (
        F.when(F.col("sa").isNull() | F.col("sb").isNull(), "unknown").when(F.col("a") == F.col("b"), "same")
        .when(F.col("sa") == F.col("sb"), F.when(F.col("qa") < F.col("qb"), "before").otherwise("after"))
        .when(F.col("ab").isNotNull() & F.col("ba").isNull(), "before").when(F.col("ba").isNotNull() & F.col("ab").isNull(), "after").otherwise("concurrent")
    )
    return j.select("submission_id", "a", "b", verdict.alias("verdict"))
