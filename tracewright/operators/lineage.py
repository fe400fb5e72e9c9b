"""Commit graphs, order of events under them, session ranges and contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.staging import discard, staged
from .components import components
from .reachability import on_loops


def graph_nodes(observed: DataFrame) -> DataFrame:
    """Nodes (repository, sha) of observations (repository, sha, parents, session_id): observations, parents state, children."""
    own = observed.groupBy("repository", "sha").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct(F.sort_array("parents")).alias("versions"))
    edges = observed.select("repository", "sha", F.explode("parents").alias("parent")).distinct()
    children = edges.groupBy("repository", F.col("parent").alias("sha")).agg(F.count(F.lit(1)).alias("children"))
    j = own.join(children, ["repository", "sha"], "full")
    state = F.when(F.col("observations").isNull(), "unrecorded").when(F.col("versions") > 1, "conflicting").otherwise("recorded")
    return j.select("repository", "sha", F.coalesce("observations", F.lit(0)).alias("observations"), state.alias("parents"), F.coalesce("children", F.lit(0)).alias("children"))


def _linked(paths: DataFrame, further: DataFrame) -> DataFrame:
    """(node, ancestor) of a path and a further one from its end."""
    return paths.join(further.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("beyond")), "ancestor").select("node", F.col("beyond").alias("ancestor"))


def ancestors(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, ancestor) closure of (node, parent), or what is reached in 2 ** rounds steps.

    A round goes on from all paths of up to 2 ** k steps by those of exactly 2 ** k: depth d takes log2(d) rounds, and a pair is
    found by few ways. Paths joined with all paths would find it once for each node between.
    """
    return reached(edges, rounds)[0]


def reached(edges: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """``ancestors``, and whether that is all."""
    paths = staged(edges.select("node", F.col("parent").alias("ancestor")).distinct(), "closure")
    steps, count, whole = paths, paths.count(), False
    for k in range(rounds):
        new = staged(paths.unionAll(_linked(paths, steps)).distinct(), "closure")
        before, count = count, new.count()
        whole = before == count
        last = whole or k + 1 == rounds
        twice = None if last else staged(_linked(steps, steps).distinct(), "closure-steps")
        discard(*([paths] if paths is steps else [paths, steps]))
        paths, steps = new, twice
        if last:
            break
    return paths, whole


def cycles(closure: DataFrame) -> DataFrame:
    """node, cycle: nodes that reach themselves, by the smallest node they reach and are reached from."""
    back = closure.join(closure.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor")), ["node", "ancestor"], "left_semi")
    return back.groupBy("node").agg(F.min("ancestor").alias("cycle"))


def cyclic_nodes(edges: DataFrame, least: float = 0.05) -> DataFrame:
    """``cycles`` of (node, parent) without its closure.

    Edges from where nothing comes or to where nothing goes on are on no cycle and are taken off, as long as that is a share
    ``least`` of all. Nodes that reach each other in a few steps become one node, so that what only lay between short cycles can
    be taken off as well. The steps double until nothing is left, or all paths of the rest are known.
    """
    every = staged(edges.select("node", "parent").where("node is not null and parent is not null").distinct(), "cycle-edges")
    found = staged(every.where("node = parent").select("node", F.col("node").alias("cycle")), "cycles")
    left = every.where("node <> parent")
    for rounds in range(2, 64):
        left, size = staged(left, "cycle-rest"), None
        while size is None or (0 < count <= (1 - least) * size):
            size = count = left.count() if size is None else count
            on = left.join(left.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
            fewer = staged(on.join(left.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent"), "cycle-rest")
            discard(left)
            left, count = fewer, fewer.count()
        if not count:
            break
        paths, whole = reached(left, rounds)
        back = paths.where("node < ancestor").select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
        one = staged(components(paths.where("node > ancestor").join(back, ["node", "ancestor"], "left_semi").select(F.col("node").alias("src"), F.col("ancestor").alias("dst")), "cycle-nodes"), "cycle-nodes")
        now = one.select(F.col("node").alias("cycle"), F.col("component").alias("whole"))
        known = found.join(now, "cycle", "left").select("node", F.coalesce("whole", "cycle").alias("cycle"))
        more = one.join(found.select("node"), "node", "left_anti").select("node", F.col("component").alias("cycle"))
        new = staged(known.unionAll(more), "cycles")
        discard(found, paths)
        found = new
        if whole:
            break
        for end in ("node", "parent"):
            left = left.join(one.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        left = left.select("node", "parent").where("node <> parent").distinct()
    return found


def presentation_order(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """place by number of ancestors (counts: node, ancestors), then node: ancestors come first."""
    j = nodes.join(counts.select("node", "ancestors"), "node", "left").withColumn("ancestors", F.coalesce("ancestors", F.lit(0)))
    return j.withColumn("place", F.row_number().over(W.partitionBy("submission_id").orderBy("ancestors", "node")).cast("long"))


def ordering_defects(sessions: DataFrame) -> DataFrame:
    """Links to a previous session that is another submission's (foreign), nobody's (dangling), or leads back over any number of sessions (cyclic)."""
    own = sessions.select("submission_id", F.col("session_id").alias("prev_session_id"), F.lit(True).alias("own"))
    any_ = sessions.groupBy(F.col("session_id").alias("prev_session_id")).agg(F.lit(True).alias("known"))
    links = sessions.where("prev_session_id is not null").join(own, ["submission_id", "prev_session_id"], "left").join(any_, "prev_session_id", "left")
    loops = on_loops(links.where("own").select(F.col("submission_id").alias("repository"), F.col("session_id").alias("node"), F.col("prev_session_id").alias("prev")))
    j = links.join(loops.select(F.col("repository").alias("submission_id"), F.col("node").alias("session_id"), F.lit(True).alias("looped")), ["submission_id", "session_id"], "left")
    defect = F.when(F.col("looped"), "cyclic").when(F.col("known").isNull(), "dangling").when(F.col("own").isNull(), "foreign")
    return j.select("submission_id", "session_id", defect.alias("defect")).where("defect is not null")


def external_classes(changes: DataFrame, contents: DataFrame, heads: DataFrame, window_ms: int = 60000) -> DataFrame:
    """Class of external changes: content known from another session's commit (git_merge_in), or a head move shortly
    before (git_unrecorded_in), else external; unclassified without a hash."""
    m = contents.select("submission_id", "sha", F.col("session_id").alias("other")).distinct()
    hit = changes.join(m, ["submission_id", "sha"]).where("other <> session_id").groupBy("submission_id", "session_id", "place").agg(F.count(F.lit(1)).alias("matches"))
    both = changes.select("submission_id", "session_id", "ms", "place", F.lit(None).cast("long").alias("head")).unionAll(heads.select("submission_id", "session_id", "ms", F.lit(None).cast("long"), F.col("ms")))
    w = W.partitionBy("submission_id", "session_id").orderBy("ms", F.asc_nulls_first("place")).rowsBetween(W.unboundedPreceding, 0)
    last = both.withColumn("last_head", F.last("head", True).over(w)).where("place is not null").select("submission_id", "session_id", "place", "last_head")
    j = changes.join(hit, ["submission_id", "session_id", "place"], "left").join(last, ["submission_id", "session_id", "place"], "left")
    kind = F.when(F.col("sha").isNull(), "unclassified").when(F.col("matches") > 0, "git_merge_in").when(F.col("ms") - F.col("last_head") <= window_ms, "git_unrecorded_in").otherwise("external")
    return j.select("submission_id", "session_id", "place", kind.alias("class"), F.coalesce("matches", F.lit(0)).alias("matches"))


def session_ranges(events: DataFrame) -> DataFrame:
    """start and stop of each session; without an end event the last event, and never before the start."""
    g = events.groupBy("submission_id", "session_id").agg(F.min("ms").alias("start_ms"), F.max(F.when(F.col("kind") == "session.end", F.col("ms"))).alias("end_ms"), F.max("ms").alias("last_ms"))
    return g.select("submission_id", "session_id", "start_ms", F.greatest("start_ms", F.coalesce("end_ms", "last_ms")).alias("stop_ms"), F.col("end_ms").isNull().alias("open_ended"))


#: Bits of a time in milliseconds.
TIME_BITS = 43


def _covered(start: Column, stop: Column) -> Column:
    """The fewest aligned stretches (level, nr: from nr * 2 ** level on, 2 ** level long) that make up [start, stop)."""

    def level(n: Column) -> Column:
        # From below: an odd first stretch and an odd end stand alone, the rest is whole stretches of the next level.
        size = F.pow(F.lit(2), n).cast("long")
        first, end = F.floor((start + size - 1) / size), F.floor(stop / size)
        at = lambda test, nr: F.when((first < end) & test, F.struct(n.alias("level"), nr.cast("long").alias("nr")))
        return F.array(at(F.pmod(first, F.lit(2)) == 1, first), at(F.pmod(end, F.lit(2)) == 1, end - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TIME_BITS)), level)))


def session_overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of a submission's sessions (contributor, machine) that strictly overlap, judged, with their overlap.

    Of two sessions that overlap, one begins while the other runs. A session's time is put together from aligned stretches,
    some ten to forty; the beginning of another lies in one stretch of each length. So both meet in exactly one stretch, and
    the work follows sessions and overlaps, not pairs.
    """
    r = ranges.where("start_ms is not null and stop_ms is not null").select("submission_id", "session_id", F.col("start_ms").cast("long").alias("s"), F.col("stop_ms").cast("long").alias("e"), F.col("contributor").alias("c"), F.col("machine").alias("m"))
    side = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("session_id", "s", "e", "c", "m")]
    runs = r.select("submission_id", *side(1), F.explode(_covered(F.col("s"), F.col("e"))).alias("at")).select("*", "at.level", "at.nr").drop("at")
    levels = runs.groupBy("submission_id").agg(F.collect_set("level").alias("levels"))  # TIME_BITS levels at most
    begins = r.join(levels, "submission_id").select("submission_id", *side(2), F.explode("levels").alias("level"))
    begins = begins.withColumn("nr", F.floor(F.col("s2") / F.pow(F.lit(2), F.col("level")).cast("long")).cast("long"))
    j = runs.join(begins, ["submission_id", "level", "nr"]).where("s1 < e2 and s2 < e1 and (s1 < s2 or session_id1 < session_id2) and session_id1 <> session_id2")
    judgement = F.when(F.col("m1").isNotNull() & (F.col("m1") == F.col("m2")), "same_machine").when(F.col("c1").isNull() | F.col("c2").isNull(), "unknown").when(F.col("c1") != F.col("c2"), "collaboration").otherwise("multi_machine")
    return j.select("submission_id", F.least("session_id1", "session_id2").alias("session_a"), F.greatest("session_id1", "session_id2").alias("session_b"), judgement.alias("judgement"), (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("overlap_ms"))


def reconciled_witnesses(seen: DataFrame, lines: DataFrame) -> DataFrame:
    """Peer observations (observer, session_id, seq_high, last_hash) against the sessions' logs."""
    last = lines.groupBy("session_id").agg(F.max("seq").alias("last_seq"), F.min("contributor").alias("owner"))
    at = lines.select("session_id", F.col("seq").alias("seq_high"), F.col("hash").alias("logged"))
    j = seen.join(last, "session_id", "left").join(at, ["session_id", "seq_high"], "left")
    verdict = (
        F.when(F.col("seq_high").isNull() | ~F.col("last_hash").rlike("^[0-9a-f]{64}$"), "malformed")
        .when(F.col("owner") == F.col("observer"), "excluded_own")
        .when(F.col("last_seq").isNull(), "absent")
        .when(F.col("seq_high") > F.col("last_seq"), "short")
        .when(F.col("logged").isNull(), "indeterminate")
        .when(F.col("logged") != F.col("last_hash"), "tip_mismatch")
        .otherwise("corroborated")
    )
    return j.select("observer", "session_id", "seq_high", verdict.alias("verdict"))


def contributor_table(sessions: DataFrame) -> DataFrame:
    return sessions.where("contributor_key is not null").groupBy("submission_id", "contributor_key").agg(F.count(F.lit(1)).alias("sessions"), *[F.count_if(F.col("contributor_kind") == k).alias(f"n_{k}") for k in ("attributed", "unverifiable", "unattributed")])


def contributors_on_roster(contributors: DataFrame, submitters: DataFrame) -> DataFrame:
    """Attributed contributors with the submitter they are, then submitters nobody is."""
    s = submitters.select("submission_id", F.col("roster_id").alias("ref"), F.lit(True).alias("submitted"))
    a = contributors.join(s, ["submission_id", "ref"], "left").select("submission_id", "contributor_key", "ref", F.coalesce("submitted", F.lit(False)).alias("is_submitter"))
    rest = s.join(contributors.select("submission_id", "ref"), ["submission_id", "ref"], "left_anti").select("submission_id", F.concat(F.lit("roster-"), F.col("ref").cast("string")).alias("contributor_key"), "ref", F.lit(True).alias("is_submitter"))
    return a.unionAll(rest)


def attributed_flags(flags: DataFrame, sessions: DataFrame) -> DataFrame:
    """Flags with the contributor of their one session, '' without."""
    return flags.join(sessions.select("submission_id", "session_id", "contributor_key"), ["submission_id", "session_id"], "left").withColumn("contributor_key", F.coalesce("contributor_key", F.lit("")))


def capabilities(events: DataFrame) -> DataFrame:
    """Per submission: git available / impossible / unknown, watched files and sessions without a git event."""
    s = events.groupBy("submission_id", "session_id").agg(F.count_if(F.col("kind") == "git.event").alias("git"), F.max(F.col("git_possible").cast("int")).alias("possible"), F.countDistinct("path").alias("files"))
    g = s.groupBy("submission_id").agg(F.sum("git").alias("git_events"), F.count_if(F.col("git") == 0).alias("silent_sessions"), F.max("possible").alias("possible"), F.max("files").alias("watched_files"))
    state = F.when(F.col("git_events") > 0, "available").when(F.col("possible") == 0, "impossible").otherwise("unknown")
    return g.select("submission_id", state.alias("git"), "git_events", "silent_sessions", "watched_files")
