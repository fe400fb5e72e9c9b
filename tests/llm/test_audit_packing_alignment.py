"""Filter audit, packing and alignment, against brute-force versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewright.llm import alignment, filter_audit, packing
from tracewright.llm import queries as llm

PATH, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdeé日") for _ in range(RNG.randint(1, 30))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", "\n", "  ", "\t", "\x0b", ". "]) for _ in range(n))


TEXTS = [
    None, "", " ", "one", "A B C", "word " * 200, "|".join("ab" * 3 for _ in range(150)), prose(150, 1), prose(150, 1), prose(400, 2) + " $", "ABC def " * 60,
    " ".join(f"w{i}" for i in range(120)), "x" * 70 + " " + "x" * 69 + "y " + "x" * 70, "é" * 40 + " " + "日本語" * 50, "\x85\xa0x 　", "long" * 30_000 + " " + "long" * 30_000, prose(20_000, 3),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("en", "fr", None, "")[i % 4]) for i, t in enumerate(TEXTS)] + [(3, "one", "en"), (40, "one", "fr"), (None, "one", "en"), (None, "alone", None), (41, TEXTS[7], "en"), (41, TEXTS[7], "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(*r, "clash", 1, "clash") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, part string, fails int, digest string").repartition(3)


def brute_audit(rows, good, toxic):
    out = defaultdict(lambda: [0] * 7)
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        n_fails = sum(fails.values())
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for i, f in enumerate(order):
                row = out[lang or "", order, i + 1]
                hit, removed = fails[f], fails[f] and not gone
                row[0] += not hit and not gone
                row[1] += removed
                row[2] += hit and gone
                row[3] += hit and n_fails == 1
                row[4] += removed and d in good
                row[5] += removed and d in toxic
                gone = gone or hit
        for order in map("".join, permutations("ABCDE")):
            if n_fails:
                chosen = next(f for f in order if fails[f])
                for other in map("".join, permutations("ABCDE")):
                    out[lang or "", other, other.index(chosen) + 1][6] += 1
    return dict(out)


def test_filter_audit(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 3 // 2, "x") for i in range(0, 50, 3)] + [(3, 0, 0, "x"), (3, 1, 0, "x"), (6, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    known = labels.collect()
    good, toxic = ({r["doc_id"] for r in known if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    got = filter_audit.audited(docs, labels).collect()
    want = brute_audit(rows, good, toxic)
    assert len(got) == len(want) == 3 * 600
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in got} == want
    assert filter_audit.audited(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    assert filter_audit.audited(docs.limit(0), labels).count() == 0


def test_transducer_counts():
    r = random.Random(2)
    parts = [*"ab AB#|\n\t", "é", "日", "😀", "wordword", "wordworx", "\x85", "x" * 65, "x" * 64 + "y"]
    for _ in range(150):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 9))]
        m = filter_audit.measures([t.encode() for t in texts])
        words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
        want = [(len(w), len(set(w)), len(t), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t))) for w, t in zip(words, texts, strict=True)]
        assert list(zip(*(m[k].tolist() for k in ("words", "distinct", "points", "capitals", "symbols")), strict=True)) == want


def test_words_with_one_hash(monkeypatch):
    """The hash table compares words, so hashes that all agree change nothing."""
    monkeypatch.setattr(filter_audit, "mixed", lambda x: x * np.uint64(0))
    texts = [prose(60, i).encode() for i in range(3)]
    assert filter_audit.measures(texts)["distinct"].tolist() == [len(set(re.findall(rb"[^\x20\x09-\x0D]+", t))) for t in texts]


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_filter_audit_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = llm.queries()["op11_filter_audit"](spark, SF)
    want = con.sql(llm.oracle_sql()["op11_filter_audit"]).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def best_sum(capacity, counts):
    """The largest reachable sum, by plain dynamic programming over single pieces, the longest one included."""
    items = [n for n, many in counts.items() for _ in range(min(many, capacity // n if n <= capacity else 0))]
    if not items:
        return 0
    items.remove(max(items))
    first = max(n for n in counts if counts[n] and n <= capacity)
    reached = {0}
    for n in items:
        reached |= {s + n for s in reached if s + n <= capacity - first}
    return first + max(reached)


def test_closest_sum():
    r = random.Random(7)
    for _ in range(300):
        capacity = r.choice([8, 31, 64])
        counts = {r.randint(1, 40): r.choice([0, 1, 2, 5, 100]) for _ in range(r.randint(1, 6))}
        total, chosen = packing.closest(capacity, counts)
        assert total == best_sum(capacity, counts) == sum(n * k for n, k in chosen.items()) and all(k <= counts[n] for n, k in chosen.items())


@pytest.mark.parametrize("window", [8, 64, 2048])
def test_plans_fill_every_sequence(window):
    r = random.Random(window)
    for case in range(30):
        many = r.choice([1, 3, 40, 3000])
        lengths = [r.randint(1, window) for _ in range(r.choice([1, 2, 30]))]
        histogram = {n: r.randint(1, many) for n in lengths} if case else {window * 3 // 4: 100_000}
        length = np.repeat(np.array(list(histogram)), list(histogram.values()))
        rank = np.concatenate([np.arange(n) for n in histogram.values()])
        plan = packing.planned(histogram, window)
        assert len(plan.key) < 60 * len(histogram) + 200
        which, before, part, sequence, offset = packing.placed(length, rank, plan.arrays())
        tokens = np.zeros(len(length), np.int64)
        np.add.at(tokens, which, part)
        assert (tokens == length).all()
        order = np.lexsort((before, which))
        same = which[order][1:] == which[order][:-1]
        assert ((before[order] + part[order])[:-1][same] == before[order][1:][same]).all() and (before[order][1:][~same] == 0).all()
        order = np.lexsort((offset, sequence))
        same = sequence[order][1:] == sequence[order][:-1]
        ends = (offset + part)[order]
        assert (ends[:-1][same] == offset[order][1:][same]).all() and (offset[order][1:][~same] == 0).all()
        full = ends[np.r_[~same, True]]
        assert (full[:-1] <= window).all() and (full != window).sum() == bin(int(length.sum()) % window).count("1")
        assert all(n & (n - 1) == 0 for n in full[full != window].tolist())


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    packed = packing.packed(docs, PATH).cache()
    got = packed.collect()
    want = Counter((d, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t, _ in rows)
    by_doc = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    # Rows with one id and length lie side by side; every start is there as often as the document.
    for (d, n), cut in by_doc.items():
        texts = [x for (i, x), k in want.items() for _ in range(k) if (i, len(x)) == (d, 4 * n)]
        for x in set(texts):
            assert all(any(y[4 * s : 4 * s + len(ids)] == ids for y in texts) for s, ids in cut)
        assert sum(len(ids) for _, ids in cut) == sum(map(len, texts))
    assert sum(r["length"] for r in got) == sum(len(x) // 4 * k for (_, x), k in want.items())
    whole = packing.sequences(packed).collect()
    assert sorted(r["sequence_id"] for r in whole) == list(range(len(whole)))
    total = sum(r["length"] for r in got)
    assert Counter(r["n_tokens"] for r in whole)[2048] == total // 2048 and all(r["n_tokens"] & (r["n_tokens"] - 1) == 0 for r in whole)
    for r in whole:
        assert len(r["ids"]) == 4 * r["n_tokens"] and [p["offset"] for p in r["pieces"]] == np.r_[0, np.cumsum([p["length"] for p in r["pieces"]])[:-1]].tolist()
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_packing_query(spark):
    """Every id of every document lies in one piece: crc32 of each piece against the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = defaultdict(list)
    for r in llm.queries()["op13_packing"](spark, SF).collect():
        found[r["doc_id"]].append(r)
    assert set(found) == set(docs)
    for d, cut in found.items():
        ids = np.array(library.encode(docs[d] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(cut, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)


def brute_alignment(texts):
    """Whole texts through both libraries; every pair of tokens compared by its byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    from tracewright.llm.bpe import byte_characters

    a, b = Tokenizer.from_file(PATH), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    of = {c: n for n, c in byte_characters().items()}
    out, documents = [], Counter()
    for t in texts:
        whole = b" " + t.encode() if t else b""
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        parts = [[bytes(of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], map(b.id_to_piece, ids[1]), strict=True)]]
        if not t or any(b"".join(p) != whole for p in parts):
            out.append(None)
            continue
        spans = []
        for own in parts:
            ends = np.cumsum([len(x) for x in own]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        group_of = {e: i for i, e in enumerate(common)}
        sides = []
        for own, span in zip(ids, spans, strict=True):
            side, at = [[]], 0
            for i, (_, e) in zip(own, span, strict=True):
                side[-1].append(str(i))
                if group_of.get(e) == at:
                    side.append([])
                    at += 1
            sides.append([",".join(x) for x in side[:-1]])
        groups = ["|".join(x) for x in zip(*sides, strict=True)]
        links, j = Counter(), 0
        for x, (s, e) in zip(ids[0], spans[0], strict=True):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links[x, ids[1][k]] += 1
                k += 1
        documents.update(set(links))
        out.append((len(ids[0]), len(ids[1]), groups, links))
    highest = {}
    for (x, _), n in documents.items():
        highest[x] = max(highest.get(x, 0), n)
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            best = sum(k for p, k in links.items() if documents[p] == highest[p[0]])
            rows.append((n_a, n_b, len(groups), sum(links.values()), best, sum(k * documents[p] for p, k in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, documents, highest


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark, docs, rows):
    extra = [(100, "tail <|endoftext|> with  two <s> blanks\n\n end ", "en"), (101, "a▁b", "en"), (102, "ｆｕｌｌ ﬁ é x\x00y \r\n\t z 😀😀", "en"), (103, "   ", "en"), (104, "a" * 3000 + " b", "en"), (105, "\n\nx\n y.\nZ", "en")]
    wide = docs.select("doc_id", "text", "lang", F.lit(1).alias("block"), F.lit("x").alias("a")).unionByName(spark.createDataFrame([(*r, 1, "x") for r in extra], "doc_id long, text string, lang string, block int, a string"))
    want, documents, highest = brute_alignment([t for _, t, _ in rows + extra])
    got = alignment.aligned(wide.repartition(5), PATH, PIECES).collect()
    assert Counter((r["doc_id"], *(r[c] for c in FIGURES)) for r in got) == Counter((d, *w) for (d, _, _), w in zip(rows + extra, want, strict=True))
    table = {(r["a"], r["b"]): (r["documents"], r["best"]) for r in alignment.links(wide, PATH, PIECES).collect()}
    assert table == {p: (n, n == highest[p[0]]) for p, n in documents.items()}
    assert alignment.aligned(wide.limit(0), PATH, PIECES).count() == 0
    assert [tuple(r[c] for c in FIGURES) for r in alignment.aligned(wide.where("text is null or text = ''"), PATH, PIECES).collect()] == [(0,) * 6 + ("",)] * 2


def test_alignment_units_random():
    r = random.Random(4)
    parts = [*"  \n\tabcdeio.,'!?-09", "the", "ing", " of", "é", "日本", "😀", "\xa0", "　", "'re", "<s>", "<|endoftext|>", "▁"]
    both = alignment.aligner(PATH, PIECES)
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(6)]
        found = both.block(texts)
        want, documents, _ = brute_alignment(texts)
        sha = [hashlib.sha256(g.encode()).hexdigest() if g is not None else "" for g in found["groups"]]
        assert list(zip(*(x.tolist() for x in found["figures"]), sha, strict=True)) == [(*w[:4], w[6]) for w in want], texts
        assert dict(zip(zip((found["keys"] >> 32).tolist(), (found["keys"] & alignment.LOW).tolist(), strict=True), found["docs"].tolist(), strict=True)) == documents


def test_galloping():
    r = random.Random(3)
    for _ in range(200):
        few, many = (sorted(r.sample(range(1, 60), r.randint(0, k))) + [60] for k in (8, 40))
        few, many = sorted((few, many), key=len)
        common, ranges = alignment.intersected(few, many)
        assert common == [(i, many.index(e)) for i, e in enumerate(few) if e in many]
        for i, (lo, hi) in enumerate(ranges):
            s, e = few[i - 1] if i else 0, few[i]
            assert list(range(lo, hi + 1)) == [k for k in range(len(many)) if (many[k - 1] if k else 0) < e and many[k] > s]


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_alignment([r["text"] for r in docs])[0]
    got = llm.queries()["op12_alignment"](spark, SF).collect()
    assert Counter((r["doc_id"], *(r[c] for c in FIGURES)) for r in got) == Counter((d["doc_id"], *w) for d, w in zip(docs, want, strict=True))
