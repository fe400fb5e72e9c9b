"""Versions of files against plain strings: the tree of pieces, last states, cuts, lines and saves."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import pytest

from tracewright.functions import rope
from tracewright.operators import contents, versions

SCHEMA = "submission_id long, path string, session_id string, seq long, global_idx long, kind string, content string, sha256 string, start_line int, start_char int, end_line int, end_char int, operation string, own boolean"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def offset(text, line, character):
    lines = text.split("\n")
    if line >= len(lines):
        return len(text)
    return sum(len(x) + 1 for x in lines[:line]) + min(character, len(lines[line]))


def test_rope_equals_strings():
    r = random.Random(3)
    for _ in range(40):
        tree, text, origins, old = None, "", [], []
        for at in range(60):
            new = "".join(r.choice("ab\n ") for _ in range(r.choice([0, 1, 3, 2500])))
            l1, l2 = sorted(r.randint(0, text.count("\n") + 1) for _ in range(2))
            c1, c2 = r.randint(0, 9), r.randint(0, 9)
            a, b = offset(text, l1, c1), offset(text, l2, c2)
            assert (rope.place(tree, l1, c1), rope.place(tree, l2, c2)) == (a, b)
            old.append((tree, text))
            tree = rope.replaced(tree, a, b, new, at)
            text, origins = text[:a] + new + text[b:], origins[:a] + [at] * len(new) + origins[b:]
        assert rope.text(tree) == text and [o for _, n, o in rope.runs(tree) for _ in range(n)] == origins
        assert all(rope.text(n) == t for n, t in old)


def edits(seed, n, files=3):
    """Random events of some files, with what plain strings make of them."""
    r = random.Random(seed)
    rows, text, origins, doubt, blobs = [], defaultdict(str), defaultdict(list), {}, defaultdict(dict)
    out = {"states": {}, "saves": [], "reasons": defaultdict(list), "recovered": defaultdict(list), "before": {}}
    for at in range(n):
        path = f"f{r.randint(1, files)}"
        kind = r.choice(["doc.open", "doc.change", "doc.change", "doc.change", "paste", "paste", "doc.save", "fs.external_change"]) if text[path] else "doc.open"
        before = text[path]
        out["before"][path, at] = (before, list(origins[path]))
        new = "".join(r.choice(["a", "b", "\n", "é", "line\n", "x y\n"]) for _ in range(r.randint(0, 12)))
        row = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")]) | {"submission_id": seed, "path": path, "session_id": f"s{at // 25}", "seq": at, "global_idx": at, "kind": kind, "own": False}
        if kind == "doc.open":
            row["content"] = new if r.random() < 0.8 or not before else None
            if row["content"] is not None:
                text[path], origins[path], doubt[path] = new, [at] * len(new), False
                blobs[path].setdefault(sha(new), new)
        elif kind in ("doc.change", "paste"):
            lines = before.count("\n") + 1
            (l1, c1), (l2, c2) = sorted((r.randint(0, lines), r.randint(0, 6)) for _ in range(2))
            row |= dict(zip(("start_line", "start_char", "end_line", "end_char"), (l1, c1, l2, c2), strict=True))
            row["content"] = new
            if kind == "paste" and r.random() < 0.4:
                row["content"] = None
                past = list(blobs[path]) or ["?"]
                row["sha256"] = r.choice([*past, "unknown"])
                new = blobs[path].get(row["sha256"])
                out["reasons"][path].append((at, "large_paste"))
                if new is None:
                    doubt[path] = True
                else:
                    out["recovered"][path].append(at)
            if new is not None:
                a, b = offset(before, l1, c1), offset(before, l2, c2)
                text[path], origins[path] = before[:a] + new + before[b:], origins[path][:a] + [at] * len(new) + origins[path][b:]
        elif kind == "doc.save":
            row["sha256"] = r.choice([sha(before), sha(before), "wrong"])
            out["saves"].append((path, at, row["sha256"], sha(before)))
            if row["sha256"] == sha(before):
                blobs[path].setdefault(sha(before), before)
        else:
            row["operation"] = r.choice(["modify", "modify", "delete"])
            row["own"] = r.random() < 0.3
            row["content"] = r.choice([before.replace("a", "c"), new, None])
            if not row["own"]:
                out["reasons"][path].append((at, "fs_external_change"))
                if row["operation"] == "delete":
                    text[path], origins[path], doubt[path] = "", [], True
                elif row["content"] is None:
                    doubt[path] = True
                else:
                    now = row["content"]
                    origins[path] = contents.merged_external(before, origins[path], now, at)
                    text[path] = now
        out["states"][path] = (text[path], list(origins[path]), doubt.get(path, False))
        rows.append(tuple(row.values()))
    return rows, out


@pytest.fixture(scope="module")
def cases():
    return [edits(seed, 120) for seed in range(12)]


@pytest.fixture(scope="module")
def events(spark, cases):
    rows = [r for c, _ in cases for r in c]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(3)


def test_last_states(events, cases):
    got = {(r["submission_id"], r["path"]): r for r in versions.file_states(events).collect()}
    assert len(got) == sum(len(out["states"]) for _, out in cases)
    recovered = 0
    for seed, (_, out) in enumerate(cases):
        for path, (text, origins, doubt) in out["states"].items():
            r = got[seed, path]
            assert (r["content"], r["sha256"], r["length"], r["tainted"]) == (text, sha(text), len(text), doubt)
            assert [x["event_seq"] for x in r["runs"] for _ in range(x["length"])] == origins
            assert [tuple(x) for x in r["reasons"]] == out["reasons"][path] and r["recovered"] == out["recovered"][path]
            assert [(x["seq"], x["recorded"], x["replayed"]) for x in r["saves"]] == [x[1:] for x in out["saves"] if x[0] == path]
            recovered += len(r["recovered"])
    assert recovered > 5


def test_cuts(spark, events, cases):
    """Changes between cuts, put together, are the whole text and its origins at every cut."""
    asked = [(seed, path, at) for seed, (_, out) in enumerate(cases) for path, at in out["before"] if at % 3]
    cuts = spark.createDataFrame(asked, "submission_id long, path string, cut long")
    got = defaultdict(list)
    for r in versions.changes_at(events, cuts).collect():
        got[r["submission_id"], r["path"]].append(r)
    assert sum(map(len, got.values())) == len(set(asked))
    for (seed, path), rows in got.items():
        text, origins = "", []
        for r in sorted(rows, key=lambda r: r["cut"]):
            tail = len(text) - r["suffix"]
            text = text[: r["prefix"]] + r["inserted"] + text[tail:]
            origins = origins[: r["prefix"]] + [x["event_seq"] for x in r["runs"] for _ in range(x["length"])] + origins[tail:]
            want = cases[seed][1]["before"].get((path, r["cut"]))
            if want[0] != text and any(x[5] == "paste" and x[6] is None for x in cases[seed][0]):
                break  # cuts don't look up large pastes
            assert (text, origins) == want and r["length"] == len(text) and r["breaks"] == text.count("\n")


def test_many_cuts_of_a_large_file(spark):
    lines = "x" * 49 + "\n"
    rows = [(1, "f", "s", 0, 0, "doc.open", lines * 20_000, None, None, None, None, None, None, False)]
    rows += [(1, "f", "s", i, i, "doc.change", "edit\n", None, i * 7 % 20_000, 3, i * 7 % 20_000, 9, None, False) for i in range(1, 10_001)]
    events = spark.createDataFrame(rows, SCHEMA)
    cuts = spark.createDataFrame([(1, "f", i) for i in range(1, 10_001)], "submission_id long, path string, cut long")
    began = time.time()
    out = versions.changes_at(events, cuts).selectExpr("count(*) as n", "sum(length(inserted)) as moved", "min(length) as shortest").head()
    seconds = time.time() - began
    plain, size, shortest = [lines[:-1]] * 20_000 + [""], 1_000_000, 1_000_000
    for i in range(1, 10_000):
        own = plain[i * 7 % 20_000]
        plain[i * 7 % 20_000 : i * 7 % 20_000 + 1] = [own[:3] + "edit", own[9:]]
        size += 5 - len(own[3:9])
        shortest = min(size, shortest)
    assert out["n"] == 10_000 and out["moved"] < 1_000_000 + 50_000 and out["shortest"] == shortest and size == len("\n".join(plain)) and seconds < 60


def test_lines(spark, events, cases):
    kinds = events.select("submission_id", "global_idx", "kind")
    kind_of = {(seed, r[4]): r[5] for seed, (rows, _) in enumerate(cases) for r in rows}
    got = {(r["submission_id"], r["path"], r["line"]): r for r in versions.line_kinds(versions.file_states(events), kinds).collect()}
    n = 0
    for seed, (_, out) in enumerate(cases):
        for path, (text, origins, _) in out["states"].items():
            at = 0
            for i, line in enumerate(text.split("\n")):
                own = origins[at : at + len(line) + 1]
                at += len(line) + 1
                r = got[seed, path, i]
                by = Counter(kind_of[seed, o] for o in own)
                best = min(by, key=lambda k: (-by[k], k)) if by else None
                assert (r["length"], r["last_event"], r["kind"], r["of_kind"]) == (len(own), max(own, default=None), best, by[best] if by else None)
                n += 1
    assert n == len(got) > 100


def brute_saves(rows):
    """Every session alone; whole texts of the last 32 states."""
    sessions = defaultdict(set)
    for r in rows:
        sessions[r[0], r[1]].add(r[2])
    states, out = {}, []
    for r in sorted(rows, key=lambda r: r[3]):
        (sub, path, session, seq, _, kind, content, recorded, l1, c1, l2, c2, _, _) = r
        shared = len(sessions[sub, path]) > 1
        s = states.setdefault((sub, session, path), {"text": "", "blind": shared, "unseen": shared, "outside": False, "recent": None})
        if kind == "doc.open":
            s["unseen"], s["blind"] = False, content is None
            if content is None:
                s["recent"] = None
            else:
                s["text"], s["recent"] = content, ((s["recent"] or []) + [content])[-32:]
        elif kind in ("doc.change", "paste") and not s["blind"]:
            if content is None:
                s["blind"], s["recent"] = True, None
            else:
                a, b = offset(s["text"], l1, c1), offset(s["text"], l2, c2)
                s["text"] = s["text"][:a] + content + s["text"][b:]
                if s["recent"] is not None:
                    s["recent"] = (s["recent"] + [s["text"]])[-32:]
        elif kind == "fs.external_change":
            s["outside"], s["blind"], s["recent"] = True, True, None
        elif kind == "doc.save":
            if s["outside"]:
                s["outside"], s["blind"], s["text"] = False, True, ""
                v = "external"
            elif s["blind"]:
                v = "unobserved" if s["unseen"] else "indeterminate"
            elif sha(s["text"]) == recorded:
                v = "match"
            else:
                v = "late" if recorded in [sha(t) for t in (s["recent"] or [])[:-1]] else "mismatch"
            out.append((sub, session, path, seq, v))
    return Counter(out)


def test_saves(spark):
    r = random.Random(9)
    rows = []
    for seed in range(30, 42):
        own = [list(x) for x in edits(seed, 150, files=2)[0]]
        for i, x in enumerate(own):
            # Sessions of two kinds: one that runs on, and those that change every 25 events.
            x[2] = "a" if seed % 2 else x[2]
            if x[5] == "fs.external_change" and r.random() < 0.6:
                x[5], x[6], x[8:12] = "doc.change", "z", [0, 0, 0, 0]
            if x[5] == "doc.save" or i % 5 == 4:
                x[5] = "doc.save"
        text, past = {}, defaultdict(list)
        for x in own:  # replay once, so that many saves hold a state of before
            if x[5] == "doc.open" and x[6] is not None:
                text[x[1]] = x[6]
            elif x[5] in ("doc.change", "paste") and x[6] is not None:
                t = text.get(x[1], "")
                a, b = offset(t, x[8], x[9]), offset(t, x[10], x[11])
                text[x[1]] = t[:a] + x[6] + t[b:]
            elif x[5] == "doc.save":
                x[7] = sha(r.choice([*past[x[1]][-40:], text.get(x[1], ""), text.get(x[1], ""), "wrong"]))
            past[x[1]].append(text.get(x[1], ""))
        rows += map(tuple, own)
    got = Counter(tuple(x) for x in versions.save_verdicts(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("submission_id", "session_id", "path", "seq", "verdict").collect())
    assert got == brute_saves(rows)
    assert len({k[4] for k in got}) == 6
