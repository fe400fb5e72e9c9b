"""Texts of files that several people worked on, against a direct reading of the rules over every pair of segments."""

import hashlib
import random
from collections import Counter, defaultdict

from test_reachability import reached
from test_versions import SCHEMA, offset

from tracewright.operators import branches, reachability


def case(sub, r):
    """Sessions with observations, links and edits of two files."""
    people = [r.choice(["ann", "bob", "bob", None]) for _ in range(r.randint(1, 4))]
    tree = [(f"c{i}", f"c{r.randint(0, i - 1)}") for i in range(1, 7)]
    events, links, at = [], [], 0
    for s, _ in enumerate(people):
        for q in range(r.randint(1, 9)):
            row = dict.fromkeys(["submission_id", "path", "session_id", "seq", "global_idx", "kind", "content", "sha256", "start_line", "start_char", "end_line", "end_char", "operation", "own", "sha"])
            kind = r.choice(["git.event", "git.event", "doc.change", "doc.change", "doc.change", "doc.open", "fs.external_change"])
            row |= {"submission_id": sub, "session_id": f"s{s}", "seq": q, "global_idx": at, "kind": kind, "own": False}
            if kind == "git.event":
                row["sha"] = f"c{r.randint(0, 7)}"
            else:
                row |= {"path": r.choice(["f", "f", "g"]), "content": f"{s}.{q}\n" if kind == "doc.change" or r.random() < 0.6 else None}
            if kind == "doc.change":
                row |= {"start_line": (line := r.randint(0, 3)), "start_char": 0, "end_line": line, "end_char": r.choice([0, 2])}
            events.append(row)
            at += 1
        if s and r.random() < 0.4:
            links.append((sub, f"s{s}", f"s{r.randint(0, s - 1)}"))
    # The log's order isn't the sessions' order.
    order = list(range(at))
    r.shuffle(order)
    for e in events:
        e["global_idx"] = order[e["global_idx"]] if sub % 2 else e["global_idx"]
    return people, tree, events, links


def relation_of(tree, events, links):
    """(session, seq) pairs: the first is surely before the second."""
    above = reached([(p, n) for n, p in tree])
    edges, seen, last = [], [], defaultdict(int)
    for e in events:
        last[e["session_id"]] = max(last[e["session_id"]], e["seq"])
        if e["sha"]:
            seen.append((e["session_id"], e["seq"], e["sha"]))
    for s, n in last.items():
        edges += [((s, q), (s, q + 1)) for q in range(-1, n + 1)]
    edges += [((prev, last[prev] + 1), (s, -1)) for _, s, prev in links]
    edges += [((s, q), (t, p)) for s, q, x in seen for t, p, y in seen if x in above.get(y, ())]
    before = reached(edges)

    def compare(a, b):
        if a[0] == b[0]:
            return (a[1] > b[1]) - (a[1] < b[1])
        ab, ba = a in before[b], b in before[a]
        return 0 if ab == ba else -1 if ab else 1

    return compare


def replay(rows):
    text, tainted = "", False
    for e in rows:
        if e["kind"] == "doc.change":
            a, b = offset(text, e["start_line"], e["start_char"]), offset(text, e["end_line"], e["end_char"])
            text = text[:a] + e["content"] + text[b:]
        elif e["content"] is not None:
            text, tainted = e["content"], tainted and e["kind"] != "doc.open"
        elif e["kind"] == "fs.external_change":
            tainted = True
    return text, tainted


def brute(people, tree, events, links, path):
    rows = sorted((e for e in events if e["path"] == path), key=lambda e: e["global_idx"])
    sessions = {e["session_id"] for e in rows}
    person = {f"s{i}": p for i, p in enumerate(people)}
    if len({person[s] for s in sessions} - {None}) < 2:
        text, tainted = replay(rows)
        return [("determinate", "single_contributor" if len(sessions) > 1 else "single_session", None, None, None, False, text, tainted)]
    compare = relation_of(tree, events, links)
    groups = defaultdict(list)
    for e in sorted(rows, key=lambda e: e["seq"]):
        window = sum(x["sha"] is not None and x["session_id"] == e["session_id"] and x["seq"] < e["seq"] for x in events)
        groups[e["session_id"], window].append(e)
    segs = list(groups.values())
    name = lambda i: (segs[i][0]["session_id"], segs[i][0]["seq"])
    n = len(segs)
    less = {(i, j) for i in range(n) for j in range(n) if i != j and compare(name(i), name(j)) < 0}
    anchored = [any(e["kind"] != "doc.change" and e["content"] is not None for e in s) for s in segs]
    tips = [i for i in range(n) if not any((i, j) in less for j in range(n))]

    def history(some):
        keep, stack = set(), list(some)
        while stack:
            x = stack.pop()
            if x not in keep:
                keep.add(x)
                stack += [] if anchored[x] else [i for i in range(n) if (i, x) in less]
        return keep

    def undecided(some):
        who = [person[name(i)[0]] for i in range(n)]
        return any((i, j) not in less and (j, i) not in less and None not in (who[i], who[j]) and who[i] != who[j] for i in some for j in some if i < j)

    def line(some):
        left, out = set(some), []
        least = lambda i: min(e["global_idx"] for e in segs[i])
        while left:
            free = [i for i in left if not any((j, i) in less for j in left)]
            chosen = min(free, key=least) if free else None
            if chosen is None:
                out += [e for i in sorted(left, key=least) for e in segs[i]]
                break
            left.discard(chosen)
            out += segs[chosen]
        return out

    live = history(tips)
    if not undecided(live):
        basis = "reanchored_after_merge" if len(tips) == 1 and anchored[tips[0]] and len(live) == 1 else "ordered_by_happens_before"
        return [("determinate", basis, None, None, None, False, *replay(line(live)))]
    out = []
    for t in tips:
        own = history([t])
        s = name(t)[0]
        out.append(("concurrent", None, person[s] or f"unattributed:{s}", s, segs[t][-1]["seq"], undecided(own), *replay(line(own))))
    return out


def test_texts_equal_brute_force(spark):
    r = random.Random(6)
    cases = [case(sub, r) for sub in range(150)]
    columns = SCHEMA + ", sha string"
    names = [c.split()[0] for c in columns.split(", ")]
    events = spark.createDataFrame([tuple(e[c] for c in names) for *_, own, _ in cases for e in own], columns).repartition(3)
    sessions = spark.createDataFrame([(sub, f"s{i}", p) for sub, (people, *_) in enumerate(cases) for i, p in enumerate(people)], "submission_id long, session_id string, contributor string")
    commits = spark.createDataFrame([(sub, 1, n, p) for sub, (_, tree, *_) in enumerate(cases) for n, p in tree], "submission_id long, repository int, sha string, parent string")
    links = spark.createDataFrame([x for *_, own in cases for x in own], "submission_id long, session_id string, prev_session_id string")
    clocks = reachability.event_clocks(events.where("sha is not null").selectExpr("*", "1 as repository"), commits, links)
    got = defaultdict(list)
    for x in branches.file_texts(events, sessions, clocks).collect():
        assert x["sha256"] == hashlib.sha256(x["content"].encode()).hexdigest() and x["length"] == len(x["content"])
        got[x["submission_id"], x["path"]].append((x["state"], x["basis"], x["contributor"], x["tip_session"], x["tip_seq"], x["ambiguous"], x["content"], x["tainted"]))
        assert x["branches"] > 1 or x["ambiguous"] or x["state"] == "determinate"
    kinds, files = Counter(), 0
    for sub, (people, tree, own, linked) in enumerate(cases):
        for path in {e["path"] for e in own} - {None}:
            want = brute(people, tree, own, linked, path)
            assert sorted(got[sub, path], key=str) == sorted(want, key=str), (sub, path)
            kinds.update((w[0], w[1], w[5]) for w in want)
            files += 1
    assert files == len(got) and len(kinds) >= 5, kinds
    some = branches.file_texts(events, sessions.where("session_id <> 's0'"), clocks).where("state = 'unknown'").collect()
    assert some and all(x["content"] is None for x in some)
