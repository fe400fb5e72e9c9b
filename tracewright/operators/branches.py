"""Which text a file has when sessions of several people worked on it: one text, one of each branch, or none that can be told.

The events of a session between two observed commits are a segment; all of them stand in one order to every event of
other sessions. Segments of a session are ordered by number, segments of different sessions by what a session had seen of the other
(``reachability.event_clocks``), so for each segment and each other session it is enough to know how many segments of that
session come before: they are the first ones. Pairs of segments are never listed.

A file whose sessions belong to one person (or to nobody known) is replayed in the order of the log. Otherwise, live segments
are those without a successor and, unless such a one sets the text itself from disk, all that come before it. If no two live
segments of different people are unordered, there is one text. Else every segment without a successor is the tip of a
branch, and each branch is replayed alone; branches share the versions of what they have in common. Unordered segments of one
person are taken in the order of the log. If a session of the file isn't among the sessions, nothing is said.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rope
from .contents import FILE, from_units, sha256
from .reachability import doors
from .versions import Final, Version, folded, inputs

TEXTS = (
    "submission_id long, path string, state string, basis string, contributor string, tip_session string, tip_seq long, ambiguous boolean, branches long, "
    "segments long, content string, sha256 string, length long, tainted boolean"
)


class Segment:
    __slots__ = ("session", "nr", "rows", "entry", "exit", "anchor", "first", "last", "least", "person")

    def __init__(self, r: dict, nr: int):
        self.session, self.nr, self.rows, self.entry, self.exit, self.anchor = r["session_id"], nr, [], r["entry"], r["exit"], False
        self.first = self.last = r["seq"]
        self.least, self.person = r["global_idx"], r["contributor"]


class Relation:
    """How the segments of a file stand to each other; each is named by (session, nr)."""

    def __init__(self, by_session: dict[str, list[Segment]], clocks: dict[tuple[str, str], tuple[list[int], list[int]]]):
        self.own = by_session
        exits = {s: [x.exit for x in own] for s, own in by_session.items()}
        #: Of each segment and other session, how many of its segments come before.
        self.seen: dict[tuple[str, str], list[int]] = {}
        for s, own in by_session.items():
            for o in by_session:
                if o != s:
                    at, upto = clocks.get((s, o), ((), ()))
                    known = [bisect_right(at, x.entry) for x in own]
                    self.seen[s, o] = [bisect_right(exits[o], upto[k - 1]) if k else 0 for k in known]

    def before(self, x: Segment, o: str) -> int:
        """Segments of a session that come before x, without those that x comes before as well."""
        return x.nr if o == x.session else min(self.seen[x.session, o][x.nr], self.after(x, o))

    def after(self, x: Segment, o: str) -> int:
        """The first segment of another session that has seen x."""
        return bisect_right(self.seen[o, x.session], x.nr)

    def followed(self, x: Segment) -> bool:
        if x.nr + 1 < len(self.own[x.session]):
            return True
        return any(o != x.session and max(self.after(x, o), self.seen[x.session, o][x.nr]) < len(self.own[o]) for o in self.own)

    def tips(self) -> list[Segment]:
        return [own[-1] for own in self.own.values() if not self.followed(own[-1])]

    def history(self, tips: list[Segment]) -> dict[str, list[Segment]]:
        """The tips and all that comes before those that don't set the text themselves, by session."""
        upto = dict.fromkeys(self.own, 0)
        for t in tips:
            if not t.anchor:
                for o in self.own:
                    upto[o] = max(upto[o], self.before(t, o))
        out = {o: own[: upto[o]] for o, own in self.own.items()}
        for t in tips:
            if t.nr >= upto[t.session]:
                out[t.session] = [*out[t.session], t]
        return {o: own for o, own in out.items() if own}

    def undecided(self, some: dict[str, list[Segment]]) -> bool:
        """Whether two of the segments, of different known people, are unordered."""
        for own in some.values():
            for x in own:
                for o, others in some.items():
                    if o == x.session or None in (x.person, others[0].person) or x.person == others[0].person:
                        continue
                    a, b = sorted((self.seen[x.session, o][x.nr], self.after(x, o)))
                    numbers = [y.nr for y in others]
                    if bisect_left(numbers, a) < bisect_left(numbers, b):
                        return True
        return False

    def line(self, some: dict[str, list[Segment]]) -> list[Segment]:
        """The segments one after the other: of those that nothing left comes before, the one first in the log."""
        done, out = dict.fromkeys(some, 0), []
        numbers = {o: [y.nr for y in own] for o, own in some.items()}
        while len(out) < sum(map(len, some.values())):
            heads = [own[done[o]] for o, own in some.items() if done[o] < len(own)]
            free = [x for x in heads if all(o == x.session or bisect_left(numbers[o], self.before(x, o)) <= done[o] for o in some)]
            if not free:  # records that contradict each other; what is left goes by the log
                return out + sorted((x for o, own in some.items() for x in own[done[o] :]), key=lambda x: x.least)
            chosen = min(free, key=lambda x: x.least)
            out.append(chosen)
            done[chosen.session] += 1
        return out


class File:
    """Holds the events of a file that several people worked on, by segment; and the clocks of its sessions, which come first."""

    def __init__(self, r: dict):
        self.file = {c: r[c] for c in FILE}
        self.clocks: dict[tuple[str, str], tuple[list[int], list[int]]] = {}
        self.own: dict[str, list[Segment]] = {}
        self.place: tuple | None = None
        self.unknown = False
        self.versions: dict[tuple, Version] = {(): Version()}

    def step(self, r: dict) -> list[dict]:
        if r["other"] is not None:
            at, upto = self.clocks.setdefault((r["session_id"], r["other"]), ([], []))
            at.append(r["entry"])
            upto.append(r["exit"])
            return []
        self.unknown |= not r["known"]
        own = self.own.setdefault(r["session_id"], [])
        if (r["session_id"], r["window"]) != self.place:
            own.append(Segment(r, len(own)))
            self.place = (r["session_id"], r["window"])
        segment = own[-1]
        segment.rows.append(r)
        segment.last, segment.least = r["seq"], min(segment.least, r["global_idx"])
        segment.anchor |= r["kind"] in ("doc.open", "fs.external_change") and r["content"] is not None
        return []

    def replayed(self, some: dict[str, list[Segment]], line: list[Segment]) -> Version:
        """The version after the segments; those of a common beginning are made once."""
        key: tuple = ()
        for x in line:
            further = (key, x.session, x.nr)
            if further not in self.versions:
                version = self.versions[key]
                for r in x.rows:
                    version = version.after(r)
                self.versions[further] = version
            key = further
        return self.versions[key]

    def finish(self) -> list[dict]:
        base = self.file | {"segments": sum(map(len, self.own.values()))}
        if self.unknown:
            return [base | {"state": "unknown", "basis": "event_outside_ordering", "branches": 0}]
        relation = Relation(self.own, self.clocks)
        tips = relation.tips()
        live = relation.history(tips)

        def row(version: Version, **more: object) -> dict:
            text = version.text()
            return base | {"content": from_units(text), "sha256": sha256(text), "length": len(text), "tainted": version.tainted, "ambiguous": False} | more

        if not relation.undecided(live):
            again = len(tips) == 1 and tips[0].anchor and sum(map(len, live.values())) == 1
            return [row(self.replayed(live, relation.line(live)), state="determinate", basis="reanchored_after_merge" if again else "ordered_by_happens_before", branches=1)]
        out = []
        for tip in tips:
            mine = relation.history([tip])
            person = tip.person if tip.person is not None else f"unattributed:{tip.session}"
            out.append(row(self.replayed(mine, relation.line(mine)), state="concurrent", contributor=person, tip_session=tip.session, tip_seq=tip.last, ambiguous=relation.undecided(mine), branches=len(tips)))
        return out


def file_texts(events: DataFrame, sessions: DataFrame, clocks: DataFrame) -> DataFrame:
    """One row for each file that has one text, with the basis of that statement; one for each branch of a file that has
    several; and one without a text where nothing can be said.

    events: content events as in ``versions.file_states`` and the observations (kind git.event) of the sessions. sessions: submission_id, session_id,
    contributor (null if nobody is known). clocks: of ``reachability.event_clocks``. Only a file with several people is held in
    a task as a whole; clocks reach it for its own sessions only.
    """
    people = sessions.select("submission_id", "session_id", F.col("contributor").cast("string").alias("contributor"), F.lit(True).alias("known"))
    placed = doors(events).select("submission_id", "session_id", "seq", "entry", "exit", "window")
    rows = inputs(events).join(people, ["submission_id", "session_id"], "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("seq", F.col("seq").cast("long"))
    per = rows.groupBy(*FILE).agg((F.min("session_id") < F.max("session_id")).alias("several"), (F.coalesce(F.min("contributor") < F.max("contributor"), F.lit(False))).alias("divergent"))

    alone = rows.join(per.where("not divergent"), list(FILE)).withColumn("wanted", F.lit(None).cast("array<string>"))
    plain = folded(alone.drop("contributor", "known"), FILE, ("global_idx",), Linear, TEXTS)

    mine = rows.join(per.where("divergent").select(*FILE), list(FILE)).join(placed, ["submission_id", "session_id", "seq"])
    own = mine.select(*FILE, "session_id").distinct()
    seen = clocks.select("submission_id", "session_id", "other", F.col("at").alias("entry"), F.col("upto").alias("exit"))
    mutual = own.join(seen, ["submission_id", "session_id"]).join(own.select(*FILE, F.col("session_id").alias("other")), [*FILE, "other"], "left_semi")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in mine.schema if f.name not in mutual.columns}
    both = mine.withColumn("other", F.lit(None).cast("string")).unionByName(mutual.select("*", *empty.values()))
    ordered = both.withColumn("later", F.col("other").isNull()).withColumn("place", F.coalesce("seq", "entry"))
    return plain.unionByName(folded(ordered, FILE, ("later", "session_id", "place"), File, TEXTS))


class Linear(Final):
    """The last state of a file that one person worked on."""

    def __init__(self, r: dict):
        super().__init__(r)
        self.several = r["several"]

    def finish(self) -> list[dict]:
        text = self.now.text()
        return [self.file | {"state": "determinate", "basis": "single_contributor" if self.several else "single_session", "ambiguous": False, "branches": 1, "content": from_units(text), "sha256": sha256(text), "length": rope.size(self.now.tree), "tainted": self.now.tainted}]
