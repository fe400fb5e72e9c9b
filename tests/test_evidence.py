"""Seals against plain hashing, and overlaps of sessions against all pairs."""

import hashlib
import json
import random
import time

from pyspark.sql import functions as F

from tracewright.operators import evidence, lineage


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_seals(spark):
    r = random.Random(3)
    logs, seals, want = [], [], {}
    for sub in range(60):
        ends = "\r\n" if sub % 4 == 0 else "\n"
        lines = [f"line {r.randint(0, 9)}é" for _ in range(r.randint(0, 8))]
        log = "".join(x + ends for x in lines) + ("rest" if sub % 3 == 0 else "")
        points = [{"seq": i, "hash": f"h{r.randint(0, 3)}"} for i in range(r.randint(0, 5))]
        meta = lambda k: json.dumps({"a": 1, "checkpoints": points[:k], "z": "é"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)  # noqa: B023, E731
        text = meta(len(points)) if sub % 7 else "{broken" if sub % 2 else '{ "checkpoints": [] }'
        logs.append((sub, "s", log, text))
        for nr in range(12):
            k, m, final = r.randint(0, len(lines)), r.randint(0, len(points)), nr % 4 == 3
            lf = nr % 2 == 0 and ends == "\r\n"
            part = "".join(x + ("\n" if lf else ends) for x in lines[:k]) + (log[len("".join(x + ends for x in lines)) :] if k == len(lines) and r.random() < 0.7 else "")
            kind = r.choice(["true", "true", "true", "wrong", "bad"])
            digest = {"true": sha(part), "wrong": sha("no" + part), "bad": r.choice([None, "zz"])}[kind]
            mine = sha(meta(m)) if nr != 5 else None
            seals.append((sub, "s", nr, digest, mine, final))
            forms = [log] + ([log.replace("\r\n", "\n")] if "\r\n" in log else [])
            row = None
            if kind == "bad":
                row = ("unavailable", None, len(log.encode()), False)
            for i, f in enumerate(forms):
                starts = [0] + [j + 1 for j, c in enumerate(f) if c == "\n"] + [len(f)]
                if row is None and sha(f) == digest:
                    row = ("exact", len(f.encode()), len(f.encode()), i > 0)
                hits = [len(f[:j].encode()) for j in starts if sha(f[:j]) == digest]
                if row is None and hits and not final:
                    row = ("partial", hits[0], len(f.encode()), i > 0)
            row = row or ("no_match", None, len(log.encode()), False)
            if sub % 7 == 0:
                other = ("unavailable", None, None)
            elif mine is None:
                other = ("unavailable", None, len(points))
            else:
                other = ("exact", m, m) if m == len(points) else ("no_match", None, len(points)) if final else ("partial", m, len(points))
            want[sub, nr] = (*row, *other)
    got = evidence.seal_coverage(spark.createDataFrame(seals, "submission_id long, session_id string, seal long, slog_sha256 string, meta_sha256 string, final boolean"), spark.createDataFrame(logs, "submission_id long, session_id string, log string, meta string")).collect()
    assert {(x["submission_id"], x["seal"]): tuple(x[c] for c in ("log", "sealed", "total", "translated", "meta", "meta_sealed", "meta_total")) for x in got} == want
    assert len({w[0] for w in want.values()}) == 4 and len({w[4] for w in want.values()}) == 4


def test_overlaps_equal_all_pairs(spark):
    r = random.Random(5)
    rows = []
    for sub in range(20):
        for i in range(r.randint(0, 15)):
            start = r.choice([r.randint(0, 40), r.randint(0, 10**12), -5, None])
            rows.append((sub, f"s{i:02}", start, None if start is None else start + r.choice([0, 1, 7, 30, 10**6, 10**12]), r.choice([None, "a", "b"]), r.choice([None, "m", "n"])))
    schema = "submission_id int, session_id string, start_ms long, stop_ms long, contributor string, machine string"
    every = lineage.session_overlaps(spark.createDataFrame(rows, schema)).collect()
    got = {(x["submission_id"], x["session_a"], x["session_b"]): (x["judgement"], x["overlap_ms"]) for x in every}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and None not in (a[2], b[2]) and a[2] < b[3] and b[2] < a[3]:
                judged = "same_machine" if a[5] and a[5] == b[5] else "unknown" if None in (a[4], b[4]) else "collaboration" if a[4] != b[4] else "multi_machine"
                want[a[0], a[1], b[1]] = (judged, min(a[3], b[3]) - max(a[2], b[2]))
    assert got == want and len(every) == len(want) > 50


def test_a_submission_of_many_sessions(spark):
    """The work follows the overlaps: a hundred thousand sessions one after the other, each overlapping the next."""
    n = 100_000
    ranges = spark.range(n).select(F.lit(1).alias("submission_id"), F.col("id").cast("string").alias("session_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 1500).alias("stop_ms"), F.lit("a").alias("contributor"), F.lit("m").alias("machine"))
    began = time.time()
    assert lineage.session_overlaps(ranges).count() == n - 1
    assert time.time() - began < 120
