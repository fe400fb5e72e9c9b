"""Rules at their thresholds, replay, line differences, graphs and order, on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions.lines import common_lines, split_lines
from tracewright.operators import checks, components, contents, lineage, rules, scoring, similarity
from tracewright.sources import logs


def events(spark, rows, extra=""):
    return spark.createDataFrame([(1, "s", *r) for r in rows], f"submission_id long, session_id string, t long, place long, kind string{extra}")


def test_external_edits_boundaries(spark):
    rows = [(0, 0, "e", "a", 100, None, None), (2000, 1, "e", "a", -5, None, None), (4001, 2, "e", "a", -101, None, None), (4002, 3, "e", "b", 100, None, False)]
    rows += [(5000, 4, "e", "b", 999, "git", False), (5001, 5, "e", "b", 999, "formatter", None), (5002, 6, "e", "c", 9, "git", True)]
    e = events(spark, rows, ", path string, diff_size long, explanation string, overridden boolean")
    got = {(r["path"], r["place"]): (r["severity"], r["edits"]) for r in rules.external_edits(e).collect()}
    assert got == {("a", 0): ("medium", 2), ("a", 2): ("high", 1), ("b", 3): ("medium", 1), ("c", 6): ("medium", 1)}
    assert {r["confidence"] for r in rules.external_edits(e).collect()} == {0.9}


def test_large_paste_boundaries(spark):
    rows = [(0, 0, "paste", 199, 9), (0, 1, "paste", 200, 1), (0, 2, "paste", 500, 1), (10000, 3, "paste", 1, 10), (10001, 4, "paste", 1, 30)]
    c = events(spark, rows, ", n_chars long, n_lines long")
    near = events(spark, [(5000, 9, "fs.external_change")])
    got = {r["place"]: (r["severity"], r["confidence"]) for r in rules.large_pastes(c, near).collect()}
    assert got == {1: ("medium", 0.6), 2: ("high", 0.6), 3: ("medium", 0.6), 4: ("high", 0.8)}
    moved = rules.large_pastes(c, near, spark.createDataFrame([(1, 2), (2, 4)], "submission_id long, place long")).collect()
    assert {r["place"]: r["severity"] for r in moved} == {1: "medium", 2: "info", 3: "medium", 4: "high"}


def test_heartbeat_gap_boundaries(spark):
    h, x = "session.heartbeat", "doc.change"
    rows = [(0, 0, h), (2000, 1, x), (300000, 2, h), (301500, 3, x), (600001, 4, h), (600500, 5, x), (900502, 6, h), (901600, 7, "session.end"), (1300000, 8, h)]
    got = rules.heartbeat_gaps(events(spark, rows).withColumn("ms", F.col("t"))).collect()
    assert [(r["place"], r["severity"], r["confidence"]) for r in got] == [(2, "medium", 0.75)]


def test_no_errors(spark):
    rows = [(1, "a", "terminal.open", None, True), (1, "a", "doc.save", None, None), *[(1, "a", "terminal.command", 0, None)] * 5]
    rows += [(2, *r[1:]) for r in rows] + [(2, "b", "terminal.open", None, False), (2, "c", "terminal.open", None, False)]
    rows += [(3, *r[1:]) for r in rows[:7]] + [(3, "b", "terminal.command", 1, None)] + [(4, *r[1:]) for r in rows[:7] if r[2] != "doc.save"]
    df = spark.createDataFrame(rows, "submission_id long, session_id string, kind string, exit_code int, integrated boolean")
    got = {(r["submission_id"], r["session_id"], r["severity"], r["confidence"]) for r in rules.no_errors(df).collect()}
    assert got == {(1, None, "medium", 0.65), (2, "b", "info", 1.0), (2, "c", "info", 1.0)}


def test_known_sources(spark):
    import random

    r = random.Random(2)
    text = lambda n: "\n".join(r.choice(["a", "b", "x", "}", ""]) + str(r.randint(0, 6)) for _ in range(n))
    blocks = [text(r.randint(1, 9)) for _ in range(12)]
    pastes = blocks[:3] + [text(r.randint(1, 9)) for _ in range(20)]
    for b in blocks:
        lines = b.split("\n")
        lines[r.randrange(len(lines))] = "new"
        pastes.append("\n".join(lines))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    p = spark.createDataFrame([(i % 3, i, sha(x), x) for i, x in enumerate(pastes)], "submission_id long, place long, sha256 string, content string")
    corpus = [(f"n{i % 7}", sha(b) if i % 2 == 0 else None, b) for i, b in enumerate(blocks)]
    got = {(x["place"], x["name"], x["severity"], x["confidence"]) for x in rules.known_sources(p, spark.createDataFrame(corpus, "name string, sha256 string, block string")).collect()}
    want = set()
    for i, x in enumerate(pastes):
        for name in {c[0] for c in corpus}:
            if any(c[0] == name and c[1] == sha(x) for c in corpus):
                want.add((i, name, "high", 0.95))
            elif any(c[0] == name and len(common_lines(split_lines(x), split_lines(c[2]))) >= 0.7 * max(x.count("\n"), c[2].count("\n")) + 0.7 for c in corpus):
                want.add((i, name, "medium", 0.8))
    assert got == want and {w[2] for w in want} == {"high", "medium"}


def test_pastes_of_solution(spark):
    final = "\n".join(map(str, range(20)))
    rows = [(1, 0, final, final), (1, 1, "\n".join(map(str, range(9))) + "\n", final), (1, 2, "\n".join(map(str, range(16))) + "\n", final), (1, 3, "\n".join(map(str, range(15))) + "\n", final), (1, 4, "", final)]
    df = spark.createDataFrame(rows, "submission_id long, place long, content string, final string")
    moves = spark.createDataFrame([(1, 2)], "submission_id long, place long")
    assert {(r["place"], r["severity"], r["confidence"]) for r in rules.pastes_of_solution(df, moves).collect()} == {(0, "high", 0.85), (2, "info", 0.85)}


def test_clock_jumps(spark):
    one = spark.createDataFrame([(1, "a", 300000), (1, "b", -300001), (1, "c", 5), (1, "c", 6)], "submission_id long, session_id string, delta_ms long")
    assert {(r["session_id"], r["severity"]) for r in rules.clock_jumps(one).collect()} == {("b", "medium"), ("c", "medium")}


def test_chain_of_canonical_lines(spark):
    prev, rows = checks.GENESIS, []
    for i in range(6):
        e = {"data": {"text": '"hash":"' + "a" * 64 + '",'}, "kind": "k", "seq": i, "t": i * 1.5, "wall": "2024"}
        body = json.dumps(e, separators=(",", ":"), sort_keys=True)
        own = hashlib.sha256((prev + body).encode()).hexdigest()
        line = json.dumps(e | {"hash": own, "prev_hash": prev}, separators=(",", ":"), sort_keys=True)
        rows.append((1, "s", i, i, e["t"], "2024", prev, own if i != 4 else "b" * 64, line if i != 2 else line.replace('"k"', '"q"')))
        prev = own
    df = spark.createDataFrame(rows, "submission_id long, session_id string, position long, seq long, t double, wall string, prev_hash string, hash string, line string").withColumn("canonical", checks.canonical_of(F.col("line")))
    assert [r["position"] for r in checks.chain_failures(df).orderBy("position").collect()] == [2, 4]
    assert [(r["position"], r["reason"]) for r in checks.first_break(df).collect()] == [(2, "hash")]


def test_log_round_trip_and_torn_tail(spark, tmp_path):
    z = "0" * 64
    good = [json.dumps({"data": {}, "hash": z, "kind": "k", "prev_hash": z, "seq": i, "t": 1.0, "wall": "w"}) for i in range(3)]
    (tmp_path / "a.slog").write_text("\n".join(good) + "\n{\"torn")
    (tmp_path / "b.slog").write_text(good[0] + "\nbroken\n" + good[1] + "\n")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.slog").write_text(good[0] + "\n")
    ok, rejects, torn = logs.read_log(spark, f"{tmp_path}/*.slog")
    assert ok.count() == 5
    assert [(r["file"].rsplit("/")[-1], r["line_no"]) for r in rejects.collect()] == [("b.slog", 2)]
    assert [(r["file"].rsplit("/")[-1], r["line_no"]) for r in torn.collect()] == [("a.slog", 4)]
    both = logs.read_log(spark, f"{tmp_path}/*.slog,{tmp_path}/other".split(",")[0]), logs.read_log(spark, f"{tmp_path}/other")
    assert [x[0].count() for x in both] == [5, 1] and logs.read_log(spark, f"{tmp_path}/{{a.slog,other/a.slog}}")[0].select("file").distinct().count() == 2


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("a\nb\n", "a\nb", 1), ("a\nb\nc\n", "b\nc\na\n", 2), ("x\n" * 5, "x\n" * 3, 3)])
def test_common_lines(a, b, n):
    assert len(common_lines(split_lines(a), split_lines(b))) == n


def test_common_lines_is_longest():
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = common_lines(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found) and found == sorted(found)


def test_replay(spark):
    rows = [
        (0, "doc.open", "one\ntwo\nthr😀e\n", None, None, None, None),
        (1, "doc.change", "X", 1, 1, 1, 2),
        (2, "paste", "new\nlines ", 2, 5, 2, 6),
        (3, "doc.change", "bad", 9, 0, 9, 0),
        (4, "fs.external_change", "one\ntXo\nother\nthr😀new\nlines \n", None, None, None, None),
    ]
    e = spark.createDataFrame([(1, "f", *r) for r in rows], "submission_id long, path string, global_idx long, kind string, content string, start_line int, start_char int, end_line int, end_char int")
    end = contents.replay(e).head()
    assert end["content"] == rows[-1][2] and end["tainted"]
    origin = [o for r in end["runs"] for o in [r["event_seq"]] * r["length"]]
    text = contents.units(end["content"])
    assert {text[i] for i, o in enumerate(origin) if o == 1} == {"X"}
    assert "".join(text[i] for i, o in enumerate(origin) if o == 4) == "other\n"
    cuts = spark.createDataFrame([(1, "f", 2), (1, "f", 3)], "submission_id long, path string, cut long")
    got = {r["global_idx"]: (r["content"], r["tainted"]) for r in contents.replay(e, cuts).collect()}
    assert got == {2: ("one\ntXo\nthr😀e\n", False), 3: ("one\ntXo\nthr😀new\nlines \n", False)}


def test_terminal_spans(spark):
    seq = ["close", "open", "open", "close", "close", "close", "open"]
    e = spark.createDataFrame([(1, "s", "t", i, 10 * i, f"terminal.{k}") for i, k in enumerate(seq)], "submission_id long, session_id string, terminal string, seq long, t long, kind string")
    assert {r["seq"]: r["open_ms"] for r in contents.terminal_spans(e).collect()} == {1: 20, 2: 20, 6: None}


def test_components_and_closure(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (200, 200), (300, 301), (301, 302), (302, 300)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys((100, 101, 102), 100), 200: 200, **dict.fromkeys((300, 301, 302), 300)}
    closure = lineage.ancestors(df.select(F.col("src").alias("node"), F.col("dst").alias("parent")))
    assert closure.where("node = 1").count() == 59
    assert {r["node"]: r["cycle"] for r in lineage.cycles(closure).collect()} == {200: 200, 300: 300, 301: 300, 302: 300}


def test_greedy_groups_equal_global_replay(spark):
    import random

    r = random.Random(4)
    lines = [f"line {i}" for i in range(60)]
    texts = {}
    for i in range(40):
        base = lines[: 20] if i % 2 else lines[20:45]
        texts[i] = "\n".join(x if r.random() > 0.05 else x + "!" for x in base) + "\n"
    pastes = [(i % 7, i, t, 200, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()]
    df = spark.createDataFrame(pastes, "submission_id long, global_idx long, content string, length long, sha256 string")
    matches = similarity.line_matches(df)
    pair = {frozenset((m["sha_a"], m["sha_b"])) for m in matches.collect()}
    want = {frozenset((a[4], b[4])) for a in pastes for b in pastes if a[4] != b[4] and len(common_lines(split_lines(a[2]), split_lines(b[2]))) >= 0.9 * max(len(split_lines(a[2])), len(split_lines(b[2])))}
    assert pair == want
    groups = []
    for sub, _, _, _, sha in sorted(pastes):
        home = next((g for g in groups if any(m == sha or frozenset((m, sha)) in pair for m in g["m"])), None)
        if home is None:
            groups.append(home := {"m": [], "s": set()})
        home["m"].append(sha)
        home["s"].add(str(sub))
    got = {(r["group_key"], r["pastes"], tuple(r["submissions"])) for r in similarity.greedy_groups(df, matches).collect()}
    assert got == {(g["m"][0], len(g["m"]), tuple(sorted(g["s"]))) for g in groups}


def test_scores_without_flags(spark):
    subs = spark.createDataFrame([(1,), (2,)], "id long")
    flags = spark.createDataFrame([(1, "a", "high", 0.5), (1, "b", "low", 1.0), (1, "off", "high", 1.0)], "submission_id long, heuristic_id string, severity string, confidence double")
    config = spark.createDataFrame([("a", True, 2.0), ("off", False, 1.0)], "heuristic_id string, enabled boolean, weight double")
    got = {r["id"]: (r["score_total"], r["score_max_severity"]) for r in scoring.submission_scores(subs, scoring.scored_flags(flags, config)).collect()}
    assert got == {1: (9.0, "high"), 2: (0.0, "info")}


def test_path_roles_and_lint(spark):
    paths = spark.createDataFrame([(1, p) for p in ("src/a.py", "src/gen/x", "doc.pdf", ".recording/s", "other")], "submission_id long, path string")
    r = spark.createDataFrame([(1, "track", "src/"), (1, "ignore", "src/gen/"), (1, "attachments", "*.pdf")], "submission_id long, list string, entry string")
    got = {x["path"]: x["role"] for x in contents.path_roles(paths, r, ".recording/").collect()}
    assert got == {"src/a.py": "reviewed", "src/gen/x": "ignored", "doc.pdf": "attachment", ".recording/s": "excluded", "other": "unscoped"}


def test_ordering_defects_of_long_loops(spark):
    """Every session that reaches itself is cyclic, whatever the loop's length; one that only leads into a loop is not."""
    loops = {n: [(n, f"s{i}", f"s{(i + 1) % n}") for i in range(n)] for n in (1, 2, 3, 4, 7)}
    rows = [r for loop in loops.values() for r in loop] + [(3, "into", "s0"), (3, "first", None), (3, "lost", "nobody"), (3, "far", "s6"), (9, "a", "b"), (9, "b", "c"), (9, "c", None)]
    got = {(r["submission_id"], r["session_id"]): r["defect"] for r in lineage.ordering_defects(spark.createDataFrame(rows, "submission_id long, session_id string, prev_session_id string")).collect()}
    assert got == {(n, s): "cyclic" for loop in loops.values() for n, s, _ in loop} | {(3, "lost"): "dangling", (3, "far"): "foreign"}
