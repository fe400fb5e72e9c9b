"""Every registered query of the library against its DuckDB SQL at the smallest scale, by columns and rows."""

import math
import os
from pathlib import Path

import pytest

from tracewright.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STREAMS = "k"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if n[0] != STREAMS))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n not in catalog.oracle_sql() and n[0] != STREAMS))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if n[0] == STREAMS))
def test_stream_equals_batch(spark, duck, name):
    test_equals_sql(spark, duck, name)


def step_by_step(name, events):
    """The detectors without SQL, event by event over each key's rows in order of seq."""
    out = []
    by_key = {}
    for r in sorted(events, key=lambda r: r["seq"]):
        by_key.setdefault((r["session_id"], r["path"]) if name.startswith("k13") else (r["session_id"],), []).append(r)
    for key, rows in by_key.items():
        memory = None
        for r in rows:
            if name == "k04_clock_skew":
                drift = r["ms"] + (700 if r["k"] % 10 == 0 else 0) - r["t"]
                if memory is not None and abs(drift - memory) >= 500:
                    out.append((*key, r["seq"], drift - memory))
                    memory = drift
                memory = drift if memory is None else memory
            elif name == "k07_explanation_tags":
                if r["kind"] in ("git.event", "formatter"):
                    memory = (r["t"], r["kind"], set())
                elif r["kind"] == "fs.external_change" and memory and r["t"] - memory[0] < 86_400_000 and r["path"] not in memory[2] and len(memory[2]) < 64:
                    memory[2].add(r["path"])
                    out.append((*key, r["seq"], r["path"], memory[1]))
            elif name == "k10_throttle":
                if memory is None or r["t"] - memory[0] >= 86_400_000:
                    out.append((*key, r["seq"], memory[1] if memory else 0))
                    memory = (r["t"], 0)
                else:
                    memory = (memory[0], memory[1] + 1)
            else:
                now = None if r["k"] % 9 == 0 else (r["k"] % 4, r["size"])
                if now is None and memory:
                    out.append((*key, r["seq"], "disappeared"))
                elif now and not memory:
                    out.append((*key, r["seq"], "appeared"))
                elif now and now[0] != memory[0]:
                    out.append((*key, r["seq"], "grew" if now[1] > memory[1] else "shrank" if now[1] < memory[1] else "changed"))
                    memory = now
                memory = now if now is None or not memory else memory
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["k04_clock_skew", "k07_explanation_tags", "k10_throttle", "k13_file_observation"])
def test_stream_equals_steps(spark, name):
    from tracewright.sources.adapters import Tables

    got = sorted((tuple(r) for r in catalog.queries()[name](spark, SF).collect()), key=repr)
    want = step_by_step(name, Tables(spark, SF).events().collect())
    assert want and got == want


def test_live_flags_keep_those_of_earlier_batches(spark, tmp_path):
    from tracewright.streaming import detectors

    config = spark.createDataFrame([("h", True, 1.0)], "heuristic_id string, enabled boolean, weight double")
    rows = lambda *x: spark.createDataFrame(list(x), "submission_id long, session_id string, seq long, heuristic_id string, severity string, confidence double")
    for i, batch in enumerate([[(1, "a", 1, "h", "low", 1.0)], [(1, "a", 2, "h", "low", 1.0), (1, "a", 1, "h", "high", 1.0)], [(2, "b", 1, "h", "low", 1.0)]]):
        for _ in range(2):  # a batch that is written again after a failure
            detectors.write_flags(rows(*batch), str(tmp_path), config, i)
    got = {(r["submission_id"], r["seq"], r["severity"]) for r in detectors.live_flags(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "high"), (1, 2, "low"), (2, 1, "low")}


def test_entry_imports_without_optional_parts(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports and has all other queries."""
    import shutil
    import subprocess
    import sys

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') for n in e.queries()); print(len(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)})
    assert found.returncode == 0 and int(found.stdout) == len(catalog.queries()), found.stderr
