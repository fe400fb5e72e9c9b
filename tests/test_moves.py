"""Internal moves against a plain reading of the rules: whole texts, every start of a run, every deletion."""

import math
import random
from collections import defaultdict

from test_versions import SCHEMA, offset

from tracewright.operators import moves

LEAST, SHARE, OWN = 8, 0.6, 0.5


def split(text):
    return [x.strip() for x in text.split("\n") if x.strip()]


def run_in(hay, needle):
    best = (0, 0)
    for i in range(len(hay)):
        n = 0
        while n < len(needle) and i + n < len(hay) and hay[i + n] == needle[n]:
            n += 1
        best = max(best, (n, -i))
    return best[0], -best[1]


def brute(rows, candidates):
    text, origins, foreign, copies, ledger = defaultdict(str), defaultdict(list), set(), {}, []
    wanted = defaultdict(list)
    for _, at, o, content in candidates:
        if len(content) >= LEAST and split(content):
            wanted[at].append((o, split(content)))
    paths = {r[1] for r in rows}
    for r in sorted(rows, key=lambda r: r[4]):
        _, path, _, _, at, kind, content, _, l1, c1, l2, c2, *_ = r
        for o, needle in wanted[at]:
            for p in sorted(paths):
                hay, spans, begin = [], [], 0
                for raw in text[p].split("\n"):
                    if raw.strip():
                        lead = len(raw) - len(raw.lstrip())
                        hay.append(raw.strip())
                        spans.append((begin + lead, begin + lead + len(raw.strip())))
                    begin += len(raw) + 1
                n, i = run_in(hay, needle)
                if n and n >= math.ceil(len(needle) * SHARE) and (at, o) not in copies:
                    own = origins[p][spans[i][0] : spans[i + n - 1][1]]
                    typed = sum(x not in foreign for x in own) / len(own)
                    if typed >= OWN:
                        copies[at, o] = ("copy", p, at, n, len(needle), typed)
        a, b = (offset(text[path], l1, c1), offset(text[path], l2, c2)) if l1 is not None else (0, 0)
        if kind in ("doc.change", "paste") and (l2 - l1 >= 1 or c2 - c1 >= LEAST) and b - a >= LEAST:
            own = origins[path][a:b]
            ledger.append((at, path, text[path][a:b], sum(x not in foreign for x in own) / len(own) >= OWN))
        if kind in ("paste", "fs.external_change"):
            foreign.add(at)
        if kind == "doc.open":
            text[path], origins[path] = content, [at] * len(content)
        elif kind != "doc.save":
            text[path], origins[path] = text[path][:a] + content + text[path][b:], origins[path][:a] + [at] * len(content) + origins[path][b:]
    for at, own in wanted.items():
        for o, needle in own:
            if (at, o) in copies:
                continue
            for when, path, gone, mine in ledger:
                n, _ = run_in(split(gone), needle)
                if when < at and mine and n and n >= math.ceil(len(needle) * SHARE):
                    copies[at, o] = ("cut", path, when, n, len(needle), 1.0)
                    break
    return copies


def test_moves_equal_brute_force(spark):
    r = random.Random(8)
    rows, candidates = [], []
    for sub in range(40):
        text = defaultdict(str)
        cut = []
        for at in range(60):
            path = f"f{r.randint(0, 2)}"
            kind = "doc.open" if not text[path] else r.choice(["doc.change", "doc.change", "doc.change", "paste", "paste", "doc.save"])
            lines = [r.choice([f"line {r.randint(0, 30)}", "  }", "return x", "", "\tif a:"]) for _ in range(r.randint(1, 5))]
            content, place = "\n".join(lines) + "\n", (None,) * 4
            if kind in ("doc.change", "paste"):
                n = text[path].count("\n")
                a = r.randint(0, n)
                b = min(n, a + r.choice([0, 0, 1, 4]))
                place = (a, 0, b, 0)
                if kind == "paste" and r.random() < 0.8:
                    source = r.choice([text[r.choice(list(text))], r.choice(cut or [""])]).split("\n")
                    i = r.randint(0, max(0, len(source) - 3))
                    content = "\n".join([*source[i : i + r.randint(1, 5)], *(["other"] if r.random() < 0.4 else [])]) + "\n"
                start, stop = offset(text[path], a, 0), offset(text[path], b, 0)
                cut += [text[path][start:stop]] if stop > start else []
                text[path] = text[path][:start] + content + text[path][stop:]
            elif kind == "doc.open":
                text[path] = content
            rows.append((sub, path, "s", at, at, kind, None if kind == "doc.save" else content, None, *place, None, False))
            if kind == "paste":
                candidates.append((sub, at, 0, content))
    events = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = spark.createDataFrame(candidates, "submission_id long, place long, ord int, content string")
    got = {(x["submission_id"], x["place"], x["ord"]): (x["move"], x["path"], x["source_place"], x["run"], x["lines"], round(x["typed"], 9)) for x in moves.internal_moves(events, asked, SHARE, OWN, LEAST).collect()}
    want = {}
    for sub in range(40):
        found = brute([x for x in rows if x[0] == sub], [x for x in candidates if x[0] == sub])
        want |= {(sub, *k): (*v[:5], round(v[5], 9)) for k, v in found.items()}
    assert got == want
    kinds = [v[0] for v in want.values()]
    assert kinds.count("copy") > 50 and kinds.count("cut") > 20


def test_runs_begin_at_the_first_line(spark):
    """Inner blanks count, and a paste with a new first line is another text."""
    hays = spark.createDataFrame([(1, 0, "a\nx = 1\ny\nz\n"), (1, 5, "a\nx = 1\ny\nz\n"), (2, 0, "q")], "submission_id long, place long, content string")
    pastes = [(1, 7, 0, "  x = 1\n\ny\nz"), (1, 8, 0, "x=1\ny\nz"), (1, 9, 0, "new\nx = 1\ny\nz"), (1, 10, 0, "a\nx = 1\ny\nw"), (2, 3, 0, " \n"), (2, 4, 0, "q"), (2, 0, 0, "q")]
    needles = spark.createDataFrame(pastes, "submission_id long, place long, ord int, content string")
    got = {(x["submission_id"], x["place"]): (x["source_place"], x["run"], x["lines"]) for x in moves.anchored(needles, hays, 0.75).collect()}
    assert got == {(1, 7): (0, 3, 3), (1, 10): (0, 3, 4), (2, 4): (0, 1, 1)}
