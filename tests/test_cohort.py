"""Lineages of a cohort and pages of its lists."""

import random
from collections import defaultdict

from tracewright.operators import cohort, similarity


def brute_lineages(commits, sessions, pool):
    groups = []
    by_key, shas = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for sub, repo, sha in commits:
        by_key["commit", f"{repo or '?'} {sha}"].add(sub)
        shas[sha][repo].add(sub)
    proof = {k: v for k, v in by_key.items() if len(v) > 1}
    for sha, own in shas.items():
        real = [x for x in own if x]
        if None in own and len(real) == 1 and len(own[None] | own[real[0]]) > 1:
            members = own[None] | own[real[0]]
            proof["commit", f"? {sha}"] = members
            proof["commit", f"{real[0]} {sha}"] = members
    held = defaultdict(set)
    for sub, key in sessions:
        held[key].add(sub)
    for key, own in held.items():
        if len(own) > 1 and (len(pool) < 5 or 2 * len(own) < len(pool)):
            proof["session", key] = own
    groups = [set(x) for x in proof.values()] + [{x} for x in pool]
    merged = []
    for g in groups:
        for other in [m for m in merged if m & g]:
            g |= other
            merged.remove(other)
        merged.append(g)
    lineage = {x: min(g) for g in merged for x in g}
    return lineage, {(lineage[min(v)], *k) for k, v in proof.items()}


def test_lineages_equal_brute_force(spark):
    r = random.Random(4)
    for case, n in enumerate((4, 6, 30)):
        pool = list(range(n))
        commits = [(r.choice(pool), r.choice([None, "r1", "r2"]), f"c{r.randint(0, 2 * n)}") for _ in range(n)] + [(i, "r9", "hot") for i in range(n * 2 // 3) if case == 1]
        sessions = [(r.choice(pool), f"s{r.randint(0, 2 * n)}") for _ in range(n // 2)] + [(i, "everyone") for i in pool[: n // 2 + 1]]
        c = spark.createDataFrame(commits + commits[:2], "submission_id int, repository string, sha string")
        s = spark.createDataFrame(sessions, "submission_id int, key string")
        p = spark.createDataFrame([(x,) for x in pool], "submission_id int")
        want, proof = brute_lineages(commits, sessions, pool)
        lines = similarity.lineages(c, s, p)
        keys = similarity.lineage_keys(c, s, p)
        assert {x["submission_id"]: x["lineage"] for x in lines.collect()} == want
        assert {tuple(x) for x in similarity.exclusion_keys(lines, keys).select("lineage", "kind", "key").collect()} == proof
        for x in similarity.lineage_exclusions(lines, keys).collect():
            members = sum(v == x["lineage"] for v in want.values())
            own = [k for k in proof if k[0] == x["lineage"]]
            assert (x["members"], x["pairs"], x["commits"]) == (members, members * (members - 1) // 2, sum(k[1] == "commit" for k in own))
            assert x["reason"] == ("same_repository_lineage" if x["commits"] else "shared_recording_scope")
    assert len(set(want.values())) > 3


def test_pages_return_every_row_once(spark):
    """Walks through all pages, with null order values and ties, in both directions."""
    r = random.Random(5)
    rows = [(i, r.choice([None, "", "a", "b"]), r.choice([None, 1.0, 2.0])) for i in range(25)]
    df = spark.createDataFrame(rows, "id int, name string, score double").cache()
    key = lambda v: (v is not None, v)
    for order in ([("name", False), ("id", False)], [("score", True), ("name", False), ("id", True)]):
        seen, after = [], None
        while True:
            got = [x.asDict() for x in cohort.page(df, order, after, 9).collect()]
            seen += [x["id"] for x in got[:9]]
            if len(got) <= 9:
                break
            after = [got[8][c] for c, _ in order]
        want = sorted([dict(zip(("id", "name", "score"), x, strict=True)) for x in rows], key=lambda x: x["id"])
        for c, desc in reversed(order):
            want.sort(key=lambda x: key(x[c]) if x[c] is not None else (False, 0), reverse=desc) if c != "name" else want.sort(key=lambda x: (x["name"] is not None, x["name"] or ""), reverse=desc)
        assert seen == [x["id"] for x in want]
