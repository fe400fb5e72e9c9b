"""Closure and cycles of random graphs against plain code, and how much is joined for them."""

import random

import pytest

from tracewright.operators import lineage


def graph(kind, r):
    if kind == "halving":  # a tree-like history with short ways back
        e = {(n, n // 2) for n in range(2, 300)} | {(n, n // 3) for n in range(5, 300, 5)}
        return sorted(e | {(n // 8, n) for n in range(48, 300, 40)})
    if kind == "line":
        return [(i, i + 1) for i in range(40)] + [(40, 20), (7, 7)]
    n = r.randint(5, 40)
    return [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(n // 2, int(1.4 * n)))]


def closed(edges):
    reach = {n: {b for a, b in edges if a == n} for n in {x for e in edges for x in e}}
    while True:
        more = {n: seen.union(*(reach[x] for x in seen)) for n, seen in reach.items()}
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("kind", ["halving", "line", "random 1", "random 2", "random 3"])
def test_equals_plain_code(spark, kind):
    edges = graph(kind, random.Random(kind))
    df = spark.createDataFrame(edges, "node long, parent long")
    want = closed(edges)
    assert {tuple(r) for r in lineage.ancestors(df).collect()} == {(a, b) for a, seen in want.items() for b in seen}
    cycle = {a: min(b for b in seen if a in want[b]) for a, seen in want.items() if a in seen}
    rows = lineage.cyclic_nodes(df).collect()
    assert (cycle or kind == "random 2") and len(rows) == len(cycle) and {r["node"]: r["cycle"] for r in rows} == cycle


def test_a_pair_is_found_few_times(spark, monkeypatch):
    joined = spark.sparkContext.accumulator(0)
    one = lineage._linked

    def counted(*a):
        df = one(*a)
        joined.add(df.count())
        return df

    monkeypatch.setattr(lineage, "_linked", counted)
    pairs = lineage.ancestors(spark.range(2, 4000).selectExpr("id as node", "id div 2 as parent")).count()
    assert joined.value < 2 * pairs
    joined.value = 0
    back = spark.range(6, 500, 5).selectExpr("id as node", "id * 8 as parent")
    assert lineage.cyclic_nodes(spark.range(2, 4000).selectExpr("id as node", "id div 2 as parent").unionAll(back)).count() > 300
    assert joined.value < pairs
