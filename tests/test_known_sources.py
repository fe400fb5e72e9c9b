"""Texts against the blocks of known sources: plain code over all pairs, and how many pairs are compared."""

import random

from pyspark.sql import functions as F

from tracewright.functions.lines import common_lines, split_lines
from tracewright.operators import rules


def varied(r, lines, n):
    out = list(lines)
    for _ in range(n):
        out[r.randrange(len(out))] = r.choice(["same", "", f"own {r.random()}"])
    return "\n".join(out) + r.choice(["", "\n"])


def near(spark, texts, blocks):
    p = spark.createDataFrame([(i, 0, f"p{i}", x) for i, x in enumerate(texts)], "submission_id long, place long, sha256 string, content string")
    c = spark.createDataFrame([(n, None, x) for n, x in blocks], "name string, sha256 string, block string")
    return {(r["submission_id"], r["name"]) for r in rules.known_sources(p, c).collect()}


def test_equals_all_pairs(spark):
    r = random.Random(2)
    stems = [[r.choice(["same", "other", "", f"line {i} {j}"]) for j in range(r.randint(1, 12))] for i in range(12)]
    texts = [varied(r, r.choice(stems), r.randint(0, 4)) for _ in range(120)] + ["", None, "same\n", "same", "\n"]
    blocks = [(r.choice(["a", "b", "c", None]), varied(r, r.choice(stems), r.randint(0, 3))) for _ in range(60)] + [("d", texts[0]), ("d", ""), ("d", None), ("e", "same\n")]
    want = set()
    for i, x in enumerate(texts):
        for name, y in blocks:
            if x and y and len(common_lines(split_lines(x), split_lines(y))) / max(x.count("\n") + 1, y.count("\n") + 1) >= 0.7:
                want.add((i, name))
    assert len(want) > 50 and near(spark, texts, blocks) == want


def test_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    r = random.Random(3)
    stem = [f"line {j}" for j in range(20)]
    copy = lambda i: "\n".join([*stem, f"own {i}", f"own {r.random()}"])
    compared = spark.sparkContext.accumulator(0)
    for name in ("shared_lines", "shared_hashes"):
        if hasattr(rules, name):
            one = F.udf(lambda n: compared.add(1) or n, "int")
            monkeypatch.setattr(rules, name, lambda *a, f=getattr(rules, name), one=one: one(f(*a)))
    found = near(spark, [copy(i) for i in range(200)], [("a", copy(-i)) for i in range(1, 100)])
    assert found == {(i, "a") for i in range(200)}
    assert compared.value < 4000  # of 19800
