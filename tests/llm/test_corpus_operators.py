"""Operators over a whole corpus, against brute-force versions on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontamination, near_dup, quality_model, suffix_index, toxicity

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, every, seed):
    r = random.Random(seed)
    words = text.split(" ")
    for i in range(seed % every, len(words), every):
        words[i] = r.choice(VOCABULARY)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = prose(300, 1)
    texts = [base, base, base.upper(), base.replace(" ", "\n")] + [edited(base, e, s) for e in (20, 40, 60, 90, 150) for s in range(8)]
    shared = prose(90, 2)
    texts += [prose(40, 10 + i) + " " + shared + " " + prose(40, 50 + i) for i in range(6)]
    texts += ["", None, "one two", "one two", "ONE TWO three four", "ab" * 600, "x" * 900, prose(2000, 3), "é" * 300 + shared, "short"]
    texts += [prose(120, 100 + i) for i in range(20)]
    ids = [3 * i + 1 for i in range(len(texts))]
    return list(zip(ids, texts, strict=True)) + [(ids[0], base), (None, base), (None, "null id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(i, t, "clash", i, "clash") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, bucket string, node long, kept string").repartition(4)


def components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    holder = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            parent[find(holder.setdefault(d, i))] = find(i)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least[find(i)], d)
    return Counter((d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("family", [near_dup.FAMILY, 0])
def test_near_duplicates(docs, rows, family):
    """In tasks by family, and by joins for families over the limit."""
    got = near_dup.grouped(docs, family=family).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("family", [near_dup.FAMILY, 0])
def test_an_id_on_two_texts(spark, family):
    """The id links their groups, but a text of each group stays, however large families are compared."""
    a, b = prose(200, 60), prose(200, 61)
    rows = [(1, a), (2, edited(a, 90, 1)), (2, b), (3, edited(b, 90, 2)), (4, ""), (4, None), (5, "same"), (5, "same"), (6, "same"), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.grouped(docs, family=family).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    if family:
        left = Counter((r["doc_id"], r["text"]) for r in near_dup.deduplicated(docs).collect())
        assert left == Counter([(1, a), (2, b), (4, ""), (4, None), (5, "same"), (5, "same"), (None, b)])


def test_a_family_is_walked_without_all_pairs():
    """Links as by all pairs; and a large family in which many tokens are common and nothing links takes seconds."""
    r = random.Random(8)
    for _ in range(60):
        base = [r.sample(range(400), r.choice([3, 20, 60])) for _ in range(3)]
        sets = sorted({frozenset([*r.sample(b, max(1, len(b) - r.randint(0, 3))), *r.sample(range(400), r.randint(0, 3))]) for b in base for _ in range(12)}, key=sorted)
        nodes = [b"%04d" % i for i in range(len(sets))]
        parent = list(range(len(sets)))
        for _ in sets:
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    if 100 * len(x & y) >= near_dup.PERCENT * len(x | y):
                        parent[i] = parent[j] = min(parent[i], parent[j])
        assert near_dup.walked(nodes, [np.array(sorted(x), near_dup.U) for x in sets]) == [nodes[p] for p in parent]
    import time

    rng, common = np.random.default_rng(1), np.arange(30)
    family = [np.unique(np.r_[common, rng.integers(100, 1 << 40, 20)]).astype(near_dup.U) for _ in range(20_000)]
    began = time.time()
    assert len(set(near_dup.walked([b"%06d" % i for i in range(20_000)], family))) == 20_000 and time.time() - began < 60


def test_signatures_estimate_similarity():
    """Without bias, and for small sets with less spread than independent hashes would have."""
    rng = np.random.default_rng(1)
    for n, cut in ((1000, 300), (50, 4)):
        want, found = (n - cut) / (n + cut), []
        for _ in range(150):
            pool = rng.integers(0, 1 << 63, n + cut, dtype=np.uint64)
            s = near_dup.signatures([np.unique(pool[:n]), np.unique(pool[cut:])])
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - want) < 0.015
    assert np.std(found) < 0.9 * (want * (1 - want) / near_dup.BANDS / near_dup.ROWS) ** 0.5


def repeats(rows, n=400):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(hash(b[i : i + n]) for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[hash(b[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize(("slot_bytes", "group_bytes"), [(suffix_index.SLOT_BYTES, suffix_index.GROUP_BYTES), (1 << 11, suffix_index.GROUP_BYTES), (suffix_index.SLOT_BYTES, 0)])
def test_repeated_strings(docs, rows, slot_bytes, group_bytes):
    """One batch and several, compared in tasks and by rows of strings."""
    got = suffix_index.without_repeats(docs, slot_bytes=slot_bytes, group_bytes=group_bytes).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == repeats(rows)


def test_repeated_strings_in_a_very_long_text(spark):
    """A text of several chunks, with strings of its own and of a short text again beyond them."""
    own = prose(220_000, 40)
    assert len(own) > suffix_index.CHUNK
    rows = [(1, own + " " + own[1000:1900] + " " + prose(50, 41)), (2, prose(80, 42) + own[-700:] + prose(80, 43)), (3, "z" * 2000)]
    got = suffix_index.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == repeats(rows)


def sharing(rows, n=51):
    """Which rows have n words in a row that another row has."""
    holders = defaultdict(set)
    for i, (_, t) in enumerate(rows):
        w = (t or "").encode().split()
        for j in range(len(w) - n + 1):
            holders[tuple(w[j : j + n])].add(i)
    found = set().union(*[h for h in holders.values() if len(h) > 1])
    return Counter((d, i in found) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("slot_bytes", "group_bytes"), [(suffix_index.SLOT_BYTES, suffix_index.GROUP_BYTES), (1 << 11, suffix_index.GROUP_BYTES), (suffix_index.SLOT_BYTES, 0)])
def test_passages_of_over_50_words(spark, docs, rows, slot_bytes, group_bytes):
    """Also those below 400 bytes, with other white space or in texts below 400 bytes; not what only one text has, nor 50 words."""
    def short(n, seed):
        return " ".join(w[:3] for w in prose(n, seed).split(" "))

    passage, other, own = short(51, 70), short(58, 71), short(60, 72)
    assert max(len(passage), len(other), len(own)) < 400
    made = [prose(80, 71) + " " + passage + " " + prose(30, 72), "\t" + passage.replace(" ", " \n"), "x" + passage, passage + "x", passage.rsplit(" ", 1)[0]]
    made += [own + " " + prose(9, 73) + " " + own, prose(200, 74), short(55, 75), short(55, 75), short(50, 76), short(50, 76), "\x85".join(["a"] * 60)]
    made += [prose(20 + 7 * i, 80 + i) + "\x0b" + " ".join(other.split(" ")[i % 8 :]) + " " + prose(60, 120 + i) for i in range(14)]
    made += [prose(5, 160 + i) + " " + " ".join(other.split(" ")[: 50 + i]) for i in range(3)]
    made = [(1000 + i, t) for i, t in enumerate(made)]
    for table, plain in ((spark.createDataFrame(made, "doc_id long, text string"), made), (docs, rows)):
        got = suffix_index.without_repeats(table, slot_bytes=slot_bytes, group_bytes=group_bytes).collect()
        assert Counter((r["doc_id"], r["shares_passage"]) for r in got) == sharing(plain)
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == repeats(plain)


def test_passages_and_strings_of_the_same_bytes(spark):
    """Texts of 51 words and 400 bytes: one stretch of words and of bytes each, of one anchor where only the last byte differs."""
    made = []
    for seed in range(12):
        words = [w[:5].ljust(5, "k") for w in prose(51, 300 + seed).split(" ")]
        text = " ".join(words) + "q" * (400 - len(" ".join(words)))
        assert len(text) == suffix_index.LENGTH and len(text.split()) == suffix_index.WORDS
        made += [(2 * seed, text), (2 * seed + 1, text[:-1] + "z")]
    got = suffix_index.without_repeats(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {(r["n_removed"], r["shares_passage"]) for r in got} == {(0, False)} and len(got) == len(made)


def test_passages_of_a_very_long_text(spark):
    """A passage across the pieces that its words come in."""
    own = prose(suffix_index.CHUNK_WORDS + 3000, 44).split(" ")
    at = suffix_index.CHUNK_WORDS - 20
    rows = [(1, " ".join(own)), (2, prose(40, 45) + " " + " ".join(own[at : at + 51])), (3, " ".join(own[at + 100 : at + 150]) + " " + prose(40, 46)), (4, " ".join(own[-51:]))]
    got = suffix_index.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["shares_passage"] for r in got} == {1: True, 2: True, 3: False, 4: True}


def test_ranks_are_the_order_of_bytes():
    r = random.Random(8)
    data = bytes(r.choice(b"ab") for _ in range(700)) * 2
    strings = np.arange(0, len(data) - suffix_index.LENGTH + 1, 3)
    rank = suffix_index.ranks(np.frombuffer(data, np.uint8), strings)
    whole = [data[i : i + suffix_index.LENGTH] for i in strings]
    order = {s: i for i, s in enumerate(sorted(set(whole)))}
    assert rank.tolist() == [order[s] for s in whole]


def test_repeated_strings_are_compared_by_bytes(monkeypatch):
    """Strings of a hash are compared, also where the hash tells none or only some apart; most stretches need no ranks."""
    r = random.Random(9)
    own, n = [bytes(r.choice(b"abcd") for _ in range(900)) for _ in range(3)], suffix_index.LENGTH
    pieces = [own[0], own[1][:100] + own[0][100:700], own[2], own[2][:n] + b"!" + own[2][n:], b"ab" * 300]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    strings = np.concatenate([at + np.arange(len(p) - n + 1) for at, p in zip(np.cumsum([0, *map(len, pieces)]), pieces, strict=False)])
    count = Counter(data[i : i + n].tobytes() for i in strings)
    want = [count[data[i : i + n].tobytes()] > 1 for i in strings]
    ranked, ranks = [], suffix_index.ranks
    monkeypatch.setattr(suffix_index, "ranks", lambda *x: ranked.append(1) or ranks(*x))
    assert suffix_index.repeated(data, strings).tolist() == want and True in want and False in want and not ranked
    for weak in (lambda d: np.zeros(len(d) - n + 1, np.uint64), lambda d: d[: len(d) - n + 1].astype(np.uint64)):
        monkeypatch.setattr(suffix_index, "hashes", weak)
        assert suffix_index.repeated(data, strings).tolist() == want
    assert len(ranked) == 2


def test_large_and_small_groups_read_texts_once(spark):
    """Stretches compared in tasks and string by string come from one join with the texts."""
    common = prose(70, 51)
    rows = [(i, prose(60, 60 + i) + common + prose(60, 90 + i)) for i in range(8)] + [(20, prose(200, 52)), (21, edited(prose(200, 52), 90, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.unhex(F.md5("text")))
    one = docs.select("text_key", F.col("doc_id").alias("one"))
    want = repeats(rows)
    for group_bytes in (3000, suffix_index.GROUP_BYTES):
        spans = suffix_index.repeated_spans(docs, one, 20_000, group_bytes=group_bytes)
        plan = spans._jdf.queryExecution().analyzed().toString()
        assert plan.count("Join") == 2 and plan.count("MapInArrow") == 2  # the texts with what is asked of them, read and compared
        got = suffix_index.without_repeats(docs.select("doc_id", "text"), group_bytes=group_bytes).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def test_family_levels_are_geometric(spark):
    keyed = spark.createDataFrame([(bytes([i] * 16), prose(120, i)) for i in range(12)], "text_key binary, text string")
    entries = suffix_index.suffixes(keyed)
    family = suffix_index.Family(4, fan=2)
    for i in range(5):
        family.add(entries.where(f"pmod(xxhash64(text_key), 5) = {i}"))
    assert {at: len(level) for at, level in family.levels.items() if level} == {0: 1, 2: 1}
    tables = [array.rows() for array in family.arrays()]
    assert sum(t.count() for t in tables) == entries.count()
    plan = tables[0].select("suffix").join(tables[1].select("suffix").hint("merge"), "suffix", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


ITEMS = [(1, "What is the capital of the land of " + prose(12, 901) + "? It is " + prose(9, 902) + "."), (2, prose(30, 903)), (3, None), (4, ""), (5, prose(150, 904)), (6, "tiny item")]


def test_decontamination(spark):
    held = [(i, prose(30, 910 + i) + " " + (t or "").upper() + " " + prose(200, 930 + i)) for i, t in ITEMS]
    near = [(11, prose(20, 960) + " " + edited(ITEMS[4][1], 40, 3)), (12, prose(20, 961) + " " + edited(ITEMS[4][1], 6, 4)), (13, ITEMS[1][1][:40] + prose(60, 962)), (14, ""), (15, None), (16, prose(3000, 963) + " " + ITEMS[1][1])]
    question, answer = ITEMS[0][1].split("? ")
    near += [(17, prose(30, 964) + " " + question + "? " + prose(60, 965)), (18, prose(30, 966) + " " + answer), (19, prose(30, 967) + f" {question}? {prose(70, 968)} {answer}"), (20, prose(90_000, 969) + " " + ITEMS[1][1])]
    docs = spark.createDataFrame(held + near, "doc_id long, text string").selectExpr("*", "'x' as item_id")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")

    def brute():
        out = set()
        for d, t in held + near:
            w = decontamination.words_of(t)
            for i, q in ITEMS:
                parts = [decontamination.shingles(p) for p in decontamination.question_and_answer(q or "")]
                every = [s for p in parts for s in p]
                shares = [sum(any(tuple(w[k : k + len(s)]) == s for k in range(len(w))) for s in p) for p in parts]
                if every and all(n >= 0.8 * len(p) for n, p in zip(shares, parts, strict=True)):
                    out.add((d, i))
        return out

    got = decontamination.contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute() >= {(1, 1), (2, 2), (5, 5), (11, 5), (16, 2), (20, 2)}
    assert not {(17, 1), (18, 1)} & brute()
    left = {r["doc_id"] for r in decontamination.decontaminated(docs, items).collect()}
    assert left == {d for d, _ in held + near} - {d for d, _ in brute()}
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), items).count() == 0 and decontamination.decontaminated(docs.limit(0), items).count() == 0


def test_decontamination_texts_under_one_id(spark):
    """Every text of an item id is looked for, and texts without an id too."""
    items = [(1, prose(40, 970)), (1, prose(40, 971)), (None, prose(40, 972)), (None, prose(40, 973)), (2, prose(40, 974)), (2, None), (3, prose(40, 974))]
    docs = [(10 + i, f"{prose(30, 980 + i)} {t} {prose(30, 990 + i)}") for i, (_, t) in enumerate(items[:5])] + [(20, prose(90, 999))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:1], "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()), key=str)
    assert found == [(10, 1), (11, 1), (12, None), (13, None), (14, 2), (14, 3)]
    assert [r["doc_id"] for r in decontamination.decontaminated(docs, items).collect()] == [20]


def test_wand_equals_full_bm25():
    """Every (passage, segment) pair at or above the threshold is found."""
    texts = {i: prose(30, 2000 + i) for i in range(300)}
    rows, n = [], len(texts)
    df = Counter(w for t in texts.values() for w in set(t.split()))
    for i, t in texts.items():
        for w, tf in Counter(t.split()).items():
            rows.append({"item_id": i, "segment": 0, "size": 30, "term": w, "tf": tf, "df": df[w], "n": n, "mean_size": 30.0})
    index = decontamination.Index(rows, texts)
    passages = [prose(60, 5000 + i) + " " + " ".join(texts[i].split()[: 10 + i % 20]) for i in range(120)]
    pair = sorted({(p, index.term[w]) for p, t in enumerate(passages) for w in t.split() if w in index.term})
    found = set(zip(*[x.tolist() for x in index.search(np.array([t for _, t in pair]), np.array([p for p, _ in pair]), len(passages))], strict=True))
    for p, t in enumerate(passages):
        words = set(t.split())
        for s, own in enumerate(index.impacts):
            if math.fsum(v for w, v in own.items() if w in words) >= decontamination.THRESHOLD:
                assert (p, s) in found


def labelled(spark, n, bad):
    rows = [(i, bad(i) if i % 3 == 0 else ". ".join(prose(9, 7000 + 20 * i + k).capitalize() for k in range(8)) + ".", int(i % 3 != 0), int(i % 3 == 0)) for i in range(n)]
    rows += [(n, "", 1, 0), (n + 1, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic").where("quality is not null")


def accuracy(scores, positive):
    hold = [r for r in scores if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return sum((r["score"] >= 0.5) == positive(r["doc_id"]) for r in hold) / len(hold)


def test_quality_model(spark):
    docs, labels = labelled(spark, 300, lambda i: " ".join(w.upper() + "$$ |" for w in prose(60, i).split()))
    model = quality_model.trained(docs, labels)
    got = quality_model.scored(docs, model).collect()
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got)
    assert accuracy([r for r in got if r["doc_id"] < 300], lambda i: i % 3 != 0) > 0.95
    assert quality_model.accepted(docs, model, 0.3).count() > 190
    assert {r["score"] for r in quality_model.scored(docs, quality_model.trained(docs, labels.limit(0))).collect()} == {0.5}


def test_quality_gradient():
    rng = np.random.default_rng(2)
    m = quality_model.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    n, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.random((8, quality_model.FEATURES))
    grad = m.gradient(x, n, y)
    loss = lambda: -np.mean(y * np.log(m.forward(x, n)["y"]) + (1 - y) * np.log(1 - m.forward(x, n)["y"]))
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])), k


def test_toxicity(spark):
    docs, labels = labelled(spark, 400, lambda i: prose(40, i) + f" you zorp{i % 7}lin " + prose(20, i + 1) + " Grubber!!")
    examples = toxicity.trained(docs, labels)
    got = toxicity.scored(docs, examples).collect()
    assert len(got) == 402 and accuracy([r for r in got if r["doc_id"] < 400], lambda i: i % 3 == 0) > 0.95
    assert all(bool(r["evidence"]) == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] < 400 and r["score"] > 0.9)
    assert toxicity.scored(docs, toxicity.trained(docs, labels.limit(0))).where("score > 0").count() == 0


def test_toxicity_equals_brute_force():
    """Weights, neighbours, votes and scores worked out one pair at a time."""
    r = random.Random(6)
    rude = ["grubber", "zorplin", "zorplash", "mudwit"]
    rows = []
    for i in range(260):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(3, 60))]
        if i % 4 == 0:
            words += r.sample(rude, r.randint(1, 2))
        rows.append({"doc_id": i, "text": " ".join(words) if i % 50 else "", "label": int(i % 4 == 0)})
    e = toxicity.Examples(rows)
    rows = toxicity.without_copies(rows)
    bags = [Counter(f for w in x["text"].split() for f in toxicity.forms(toxicity.bare(w))) for x in rows]
    n, n1 = len(rows), sum(x["label"] for x in rows)
    df, df1 = Counter(t for b in bags for t in b), Counter(t for b, x in zip(bags, rows, strict=True) if x["label"] for t in b)

    def strength(t):
        k, a = df[t], df1[t]
        chi = n * (a * n - k * n1) ** 2 / (k * (n - k) * n1 * (n - n1)) if a * n > k * n1 else 0
        if chi < toxicity.SIGNIFICANT and t.startswith(toxicity.STEM):
            return None
        return (toxicity.FLOOR + (math.sqrt(chi / n) if chi >= toxicity.SIGNIFICANT else 0)) * (math.log((1 + n) / (1 + k)) + 1)

    def vector(bag):
        v = {t: (1 + math.log(c)) * strength(t) for t, c in bag.items() if t in df and strength(t) is not None}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {x["doc_id"]: vector(b) for x, b in zip(rows, bags, strict=True)}
    label = {x["doc_id"]: x["label"] for x in rows}
    places = {d: i for i, d in enumerate(e.ids.tolist())}
    assert set(places) == {d for d, v in vectors.items() if v} and set(e.term) == {t for v in vectors.values() for t in v}
    cosine = lambda v, w: sum(x * w.get(t, 0) for t, x in v.items())

    def vote(v, own=None):
        near = sorted(((-round(cosine(v, vectors[d]), 12), i) for d, i in places.items() if d != own))[: toxicity.K]
        weight = [s * s for s, _ in near]
        return sum(w * label[e.ids[i]] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight), [int(e.ids[i]) for _, i in near[:3]]

    votes = np.array([vote(vectors[d], d)[0] for d in e.ids.tolist()])
    order = np.argsort(votes, kind="stable")
    xs, ys = e.curve
    assert (np.diff(xs) > 0).all() and (np.diff(ys) > 0).all() and votes[order[0]] <= xs[0] + 1e-9
    for i in range(60):
        bag = Counter(f for w in [r.choice(VOCABULARY) for _ in range(30)] + r.sample(rude, i % 3) + ["unknownword"] for f in toxicity.forms(w))
        terms, tf = (np.array(x) for x in zip(*sorted((e.term[t], c) for t, c in bag.items() if t in e.term), strict=True))
        score, near = e.judge([(terms, tf.astype(float))])[0]
        want, evidence = vote(vector(bag))
        assert abs(score - np.clip(np.interp(want, xs, ys), 0, 1)) < 1e-6 and near == evidence


def test_examples_with_a_common_footer_are_no_copies():
    footer = " " + prose(12, 5)
    rows = [{"doc_id": i, "text": prose(20, 3000 + i) + footer, "label": i % 2} for i in range(200)]
    assert toxicity.without_copies(rows) == rows
    copies = [{"doc_id": 900 + i, "text": edited(rows[1]["text"] + " " + prose(300, 8), 400, i), "label": 1} for i in range(3)]
    assert toxicity.without_copies(copies + rows + [dict(copies[0], label=0)]) == copies[:1] + rows + [dict(copies[0], label=0)]


def test_scores_of_odd_tables(spark):
    """Repeated rows and ids, ties, clashing columns, null, empty and very long texts, and no rows at all."""
    docs, labels = labelled(spark, 120, lambda i: prose(20, i) + " zorplin grubber! " + prose(12, i + 1))
    odd = [(3, docs.where("doc_id = 3").head()["text"]), (3, "other text of three"), (None, None), (500, prose(150_000, 1) + " grubber"), (501, "7 7 7"), (502, "7 7 7")]
    wide = docs.unionAll(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as label", "'x' as score", "'y' as evidence").repartition(5)
    for module, column, train in ((toxicity, "toxic", lambda d, x: toxicity.trained(d, x)), (quality_model, "quality", lambda d, x: quality_model.trained(d, x))):
        model = train(wide, labels.unionAll(labels))
        got = module.scored(wide, model).select("doc_id", "score").collect()
        assert len(got) == 128 and all(0 <= g["score"] <= 1 for g in got), column
        again = module.scored(wide, train(wide, labels)).select("doc_id", "score").collect()
        assert sorted(got, key=str) == sorted(again, key=str)
        same = [g["score"] for g in got if g["doc_id"] in (501, 502)]
        assert same[0] == same[1]
        none = wide.limit(0)
        assert module.scored(none, model).count() == 0 and module.scored(none, train(none, labels)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.grouped(none).count() == 0
    assert suffix_index.without_repeats(none).count() == 0
    assert near_dup.deduplicated(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 200, lambda i: " ".join(w.upper() + "$$ |" for w in prose(60, i).split()))
    leak = prose(30, 903)
    extra = [(1000, "Mail me at a.b@mail.example.com, " + prose(70, 77).capitalize() + ".", ), (1001, prose(40, 78).capitalize() + ". " + leak + "."), (1002, "Mail me at a.b@mail.example.com, " + prose(70, 77).capitalize() + ".")]
    docs.unionAll(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1000 in left and 1001 not in left and 1002 not in left
    assert not any(i % 3 == 0 for i in left if i is not None and i < 200) and sum(i % 3 != 0 for i in left if i is not None and i < 200) > 125


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null, empty and repeated texts, an id on two texts, clashing extra columns; and tables without rows."""
    import corpus_pipeline

    good = lambda i: ". ".join(prose(9, 7000 + 20 * i + k).capitalize() for k in range(8)) + "."
    rows = [(i, good(i)) for i in range(40)] + [(3, good(3)), (50, None), (51, ""), (None, None), (52, good(60)), (52, good(61)), (53, good(61)), (54, prose(60_000, 9).capitalize() + ".")]
    extra = "'en' as lang, 's' as source, cast(length(text) as bigint) as n_chars, 'x' as family, 1 as score, 'y' as told, 2 as item_id, 'z' as node, 'k' as key, 1 as __id, 2 as __tail, 3 as __key, 4 as __told, 5 as __answer"
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *extra.split(", "))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(30, 903))], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/some/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*range(40), 3, 50, 51, None, 52, 52, 54])
    assert {r["doc_id"]: r["n_tokens"] for r in got}[51] == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_contaminated_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, prose(40, 3)), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(30, 4))], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, spark.createDataFrame([(1, None), (2, "")], "item_id long, text string"))):
        assert decontamination.contaminated(d, i).count() == 0
        assert decontamination.decontaminated(d, i).count() == d.count()
