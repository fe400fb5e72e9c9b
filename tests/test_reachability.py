"""The reachability index and the order of events, against plain graph walks."""

import random
from collections import defaultdict

from tracewright.operators import reachability as op


def reached(edges):
    """node -> all nodes that lead to it, by walking; edges are (from, to)."""
    before, nodes = defaultdict(set), set()
    for a, b in edges:
        before[b].add(a)
        nodes |= {a, b}
    out = {}
    for n in nodes:
        seen, stack = set(), list(before[n])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += before[x]
        out[n] = seen
    return out


def test_index_equals_walks(spark):
    """Many random graphs at once, one a repository: trees, merges, cycles, self loops, a long line."""
    r = random.Random(1)
    edges = []
    for g in range(40):
        n = r.randint(2, 14)
        for _ in range(r.randint(1, 2 * n)):
            a, b = r.randint(0, n), r.randint(0, n)
            edges.append((g, max(a, b), min(a, b)) if g % 3 else (g, a, b))
    edges += [(40, i + 1, i) for i in range(300)] + [(41, 5, 5), (41, 6, 5), (None, 1, 2)]
    index = op.Index(spark.createDataFrame(edges + edges[:9], "repository int, node long, parent long"))
    want, found = {}, {}
    for g in range(42):
        own = reached([(p, n) for k, n, p in edges if k == g])
        want |= {(g, n): before for n, before in own.items()}
    nodes = spark.createDataFrame(list(want), "repository int, node long")
    for x in index.ancestors(nodes).collect():
        found.setdefault((x["repository"], x["node"]), set()).add(x["ancestor"])
    # A node on a cycle reaches itself; the index leaves the node itself out unless the cycle's rows say so.
    assert all(found.get(k, set()) - {k[1]} == before - {k[1]} for k, before in want.items())
    assert {(x["repository"], x["node"]): x["ancestors"] for x in index.ancestor_counts(nodes.where("repository = 40")).collect()} == {(40, i): i for i in range(301)}
    pairs = [(g, r.randint(0, 9), r.randint(0, 9)) for g in range(42) for _ in range(12)]
    got = {(x["repository"], x["a"], x["b"]): x["verdict"] for x in index.compared(spark.createDataFrame(pairs, "repository int, a long, b long").distinct()).collect()}
    for g, a, b in pairs:
        ab, ba = a in want.get((g, b), ()), b in want.get((g, a), ())
        verdict = "unknown" if (g, a) not in want or (g, b) not in want else "same" if a == b else "unordered" if ab == ba else "before" if ab else "after"
        assert got[g, a, b] == verdict, (g, a, b)
    assert index.seen.where("repository = 40").count() == 0


def test_loops(spark):
    links = [(1, i, i - 1) for i in range(1, 9)] + [(2, i, (i + 1) % 5) for i in range(5)] + [(2, 9, 0), (3, 1, 1), (4, 1, 2), (4, 2, 1), (4, 3, 2)]
    got = {tuple(x) for x in op.on_loops(spark.createDataFrame(links, "repository int, node int, prev int")).collect()}
    assert got == {*((2, i) for i in range(5)), (3, 1), (4, 1), (4, 2)}


def test_event_order_equals_walks(spark):
    """Sessions with observations, links and commits, many submissions at once; each event compared with each other."""
    r = random.Random(2)
    events, commits, links, edges, names = [], [], [], defaultdict(list), defaultdict(list)
    for sub in range(25):
        tree = [(f"c{i}", f"c{r.randint(0, i - 1)}") for i in range(1, 8) for _ in range(r.randint(1, 2))]
        commits += [(sub, 7, n, p) for n, p in tree]
        above = reached([(p, n) for n, p in tree])
        seen, at = [], 0
        for s in range(r.randint(2, 4)):
            rows = [(q, f"c{r.randint(0, 8)}" if r.random() < 0.4 else None) for q in range(r.randint(1, 6))]
            for q, sha in rows:
                events.append((sub, f"s{s}", q, at, "git.event" if sha else "doc.change", 7 if sha else None, sha))
                names[sub].append((at, f"s{s}", q))
                at += 1
                seen += [(s, q, sha)] if sha else []
            edges[sub] += [((s, q), (s, q + 1)) for q in range(-1, len(rows))]  # -1 is the start, len(rows) the end
            if s and r.random() < 0.4:
                prev = r.randint(0, s - 1)
                links.append((sub, f"s{s}", f"s{prev}"))
                edges[sub].append(((prev, "end"), (s, -1)))
            edges[sub].append(((s, len(rows)), (s, "end")))
        edges[sub] += [((s, q), (t, p)) for s, q, x in seen for t, p, y in seen if x in above.get(y, ())]
    e = spark.createDataFrame(events, "submission_id int, session_id string, seq int, global_idx int, kind string, repository int, sha string")
    clocks = op.event_clocks(e.where("sha is not null"), spark.createDataFrame(commits, "submission_id int, repository int, sha string, parent string"), spark.createDataFrame(links, "submission_id int, session_id string, prev_session_id string"))
    pairs = [(sub, a[0], b[0]) for sub, own in names.items() for a in own for b in own] + [(0, 0, 999)]
    got = {(x["submission_id"], x["a"], x["b"]): x["verdict"] for x in op.event_order(spark.createDataFrame(pairs, "submission_id int, a int, b int"), e, clocks).collect()}
    assert got.pop((0, 0, 999)) == "unknown" and len(got) == len(pairs) - 1
    kinds = set()
    for sub, own in names.items():
        above = reached(edges[sub])
        for i, s, q in own:
            for k, t, p in own:
                a, b = (int(s[1:]), q), (int(t[1:]), p)
                ab, ba = a in above[b], b in above[a]
                want = "same" if a == b else ("before" if q < p else "after") if s == t else "concurrent" if ab == ba else "before" if ab else "after"
                assert got[sub, i, k] == want, (sub, a, b)
                kinds.add((s == t, want))
    assert len(kinds) == 6
