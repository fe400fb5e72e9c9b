"""Personal data: exact patterns, and words around it that give it away.

Four kinds are found by pattern (email, ip, card, phone). Then, as in C-sanitisation, a word discloses an entity if
seeing the word tells nearly as much as seeing the entity itself. Over the corpus, a context is the words within WINDOW
words of an entity; what stands outside all contexts is cut, line by line, into windows of 2 * WINDOW words. Equal
contexts of an entity, and equal windows, count once (copies of a text). With n contexts and windows in all, n_c of them
contexts of entity c, n_w contexts and windows that hold word w, and n_wc contexts of c that hold w:

    information of c     IC(c)     = log(n / n_c)
    disclosure by w      PMI(w, c) = log(n_wc / n_c) - log(n_w / n)   at most IC(c)
    w is removed near c  if n_wc >= SUPPORT and PMI(w, c) >= DISCLOSURE * IC(c)

A removed word becomes the span kind ``term`` in the contexts of that entity; ``generalised`` replaces each span by its
kind. All counts cover the whole corpus, text without personal data too, in that one unit. A word over the largest n_w
that any of its pairs allows is out, so a task passes on no more windows of it than decide that.

Null text counts as empty and gives no spans. Every input row gives a row, repeated ids too. Extra columns are not read.
A task holds a few megabytes of texts, or one very long text, at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ._jobs import plain_names, staged, texts
from .bpe import slices

KINDS = ("email", "ip", "card", "phone")
WINDOW = 6
SUPPORT = 3
DISCLOSURE = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can only start where a run of digits starts, so no run is tried again from its inside.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>|*#$%&"
#: Entries of a task's tables before they are passed on.
HELD = 200_000
#: Words are looked up by their hash modulo this, whatever the number of words asked for.
SLOTS = 1 << 18

Span = tuple[int, int, str]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, one try for each @: the local part is the run before it, as far as the last match's end."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def found(text: str) -> list[Span]:
    """Spans (start, end, kind) by start, then kind in the order of KINDS."""
    spans: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                spans.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
                    spans.append((*m.span(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def hashed(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def entity(text: str, span: Span) -> int:
    """The same address, number or host, however it is spaced or cased."""
    value = text[span[0] : span[1]].lower()
    return hashed(f"{span[2]}:{value if span[2] in ('email', 'ip') else ''.join(DIGITS.findall(value))}")


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def words_before(text: str, end: int) -> list[tuple[int, int, str]]:
    """The last WINDOW words of text[:end] with their places; a stretch that may begin inside one of them is read wider."""
    width = 16 * WINDOW
    while True:
        start = max(0, end - width)
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text, start, end)]
        if start == 0 or len(words) > WINDOW:
            return words[-WINDOW:]
        width *= 4


def contexts(text: str, spans: list[Span]) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """For each span its entity, a hash of its context and the words of the context with their places."""
    for span in spans:
        around = words_before(text, span[0])
        for k, m in enumerate(WORD.finditer(text, span[1])):
            if k == WINDOW:
                break
            around.append((*m.span(), m.group()))
        around = [w for w in around if bare(w[2]) and not any(w[0] < s[1] and s[0] < w[1] for s in spans)]
        yield entity(text, span), hashed("\n".join(w[2] for w in around)), around


def mentions(docs: DataFrame) -> DataFrame:
    """entity, context, words (array of hashes): one row for each span, no more than 2 * WINDOW words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for text in part.column("text").to_pylist():
                if text and (spans := found(text)):
                    rows += [(e, c, sorted({hashed(bare(w)) for *_, w in words})) for e, c, words in contexts(text, spans)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["entity", "context", "words"])

    return docs.mapInArrow(run, "entity long, context long, words array<long>")


def background(text: str) -> Iterator[list[str]]:
    """The words outside all contexts and spans, in windows that start anew with each line."""
    if spans := found(text):
        ranges = [s[:2] for s in spans] + [w[:2] for *_, words in contexts(text, spans) for w in words]
        out, done = [], 0
        for a, b in sorted(ranges):
            out.append(text[done : max(a, done)])
            done = max(done, b)
        text = " ".join([*out, text[done:]])
    for line in text.split("\n"):
        words = WORD.findall(line)
        for i in range(0, len(words), 2 * WINDOW):
            yield words[i : i + 2 * WINDOW]


def windows(docs: DataFrame) -> DataFrame:
    """window (hash): the windows of all texts, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[int] = set()
        for part in (part for batch in batches for part in slices(batch)):
            for text in part.column("text").to_pylist():
                held.update(hashed("\n".join(words)) for words in background(text or ""))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["window"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["window"])

    return docs.select("text").mapInArrow(run, "window long").distinct()


def windows_with(docs: DataFrame, most: np.ndarray) -> DataFrame:
    """word, window (hashes): the windows of words whose slot in ``most`` is not negative, one more than it says at least if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int | None] = {}
        held: defaultdict[int, set[int]] = defaultdict(set)
        size = 0
        for part in (part for batch in batches for part in slices(batch)):
            for text in part.column("text").to_pylist():
                for words in background(text or ""):
                    mine = set()
                    for raw in words:
                        if raw not in known:
                            word = hashed(bare(raw))
                            known[raw] = word if most[word % SLOTS] >= 0 else None
                        if known[raw] is not None:
                            mine.add(known[raw])
                    if mine:
                        window = hashed("\n".join(words))
                        for word in mine:
                            if len(held[word]) <= most[word % SLOTS] and window not in held[word]:
                                held[word].add(window)
                                size += 1
                if size > HELD:
                    yield rows(held)
                    held.clear()
                    size = 0
                if len(known) > HELD:
                    known.clear()
        yield rows(held)

    def rows(held: dict[int, set[int]]) -> pa.RecordBatch:
        word = np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array([w for x in held.values() for w in x], pa.int64())], names=["word", "window"])

    return docs.select("text").mapInArrow(run, "word long, window long").distinct()


def disclosing(docs: DataFrame) -> DataFrame:
    """entity, word, pmi, ic: pairs over the threshold. Only words that their contexts alone don't rule out are counted in the corpus."""
    seen = staged(mentions(docs).groupBy("entity", "context").agg(F.first("words").alias("words")), "pii-contexts")
    entities = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    held = seen.select("entity", F.explode("words").alias("word"))
    pairs = staged(held.groupBy("entity", "word").agg(F.count(F.lit(1)).alias("n_wc")).where(F.col("n_wc") >= SUPPORT), "pii-pairs")
    n = F.lit(max(1, seen.count() + windows(docs).count()))
    near = held.join(pairs.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"))
    # The threshold, solved for n_w and rounded up, less the contexts.
    most = F.ceil(F.col("n_wc") * F.pow(n / F.col("n_c"), F.lit(1 - DISCLOSURE))) - F.col("n_near")
    open_ = staged(pairs.join(near, "word").join(entities, "entity").withColumn("most", most).where(F.col("most") >= 0), "pii-open")
    slots = np.full(SLOTS, -1, np.int64)
    for r in open_.groupBy(F.pmod("word", F.lit(SLOTS)).alias("slot")).agg(F.max("most").alias("most")).collect():
        slots[r["slot"]] = r["most"]
    far = windows_with(docs, slots).join(open_.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n_far"))
    n_w = F.col("n_near") + F.coalesce("n_far", F.lit(0))
    ic = F.log(n / F.col("n_c"))
    pmi = F.least(F.log(F.col("n_wc") / F.col("n_c")) - F.log(n_w / n), ic)
    return open_.join(far, "word", "left").select("entity", "word", pmi.alias("pmi"), ic.alias("ic")).where(F.col("pmi") >= DISCLOSURE * F.col("ic"))


TOLD = ArrayType(StructType([StructField("entity", LongType()), StructField("word", LongType())]))


def every_span(text: str, known: list[dict] | None) -> list[Span]:
    """Base spans, and words that disclose one of the text's own entities."""
    base = found(text)
    if not known:
        return base
    pair = {(k["entity"], k["word"]) for k in known}
    more = {(a, b, "term") for e, _, words in contexts(text, base) for a, b, w in words if (e, hashed(bare(w))) in pair}
    return sorted([*base, *more], key=lambda s: (s[0], (*KINDS, "term").index(s[2])))


def pair_slot(entity: int, word: int) -> int:
    return (entity * 31 + word) % SLOTS


def told_rows(rows: DataFrame, pairs: DataFrame, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``finish`` of the rows with TOLD: the disclosing pairs among the text's own mentions, null if there are none.

    A bitmap of SLOTS bits of the pairs goes to every task. Only texts with a mention that it holds move, keyed by text, and
    what those mentions are; all others are finished where they are. So it is with any number of pairs. No stage has two
    Python steps, which would double the workers that an executor keeps.
    """
    entity, word = F.col("entity").cast("decimal(38,0)"), F.col("word").cast("decimal(38,0)")
    held = np.zeros(SLOTS, bool)
    held[[r["slot"] for r in pairs.select(F.pmod(entity * 31 + word, F.lit(SLOTS)).cast("int").alias("slot")).distinct().collect()]] = True  # SLOTS rows at most

    def mentioned(part: pa.RecordBatch) -> list[list[dict] | None]:
        out: list[list[dict] | None] = []
        for text in part.column("text").to_pylist():
            spans = found(text) if text else []
            own = {(e, hashed(bare(w))) for e, _, words in contexts(text, spans) for *_, w in words} if spans else ()
            own = sorted(p for p in own if held[pair_slot(*p)])
            out.append([{"entity": e, "word": w} for e, w in own] or None)
        return out

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            told = mentioned(part)
            left = part.filter(pa.array([t is None for t in told], pa.bool_()))
            yield finish(left.append_column("__told", pa.nulls(left.num_rows, TOLD_ARROW)))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            told = mentioned(part)
            yield part.append_column("__told", pa.array(told, TOLD_ARROW)).filter(pa.array([t is not None for t in told], pa.bool_()))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            yield finish(part)

    moved = rows.mapInArrow(move, StructType([*rows.schema.fields, StructField("__told", TOLD)])).select("*", F.xxhash64("text").alias("__key"))
    asked = moved.select("__key", F.explode("__told").alias("m")).select("__key", "m.entity", "m.word").distinct()
    told = asked.join(pairs.select("entity", "word"), ["entity", "word"]).groupBy("__key").agg(F.collect_set(F.struct("entity", "word")).alias("__answer"))  # bounded by the text's own mentions
    # A merge join at every size: the last step is then in a stage of its own.
    answered = moved.join(told.hint("merge"), "__key", "left").select(*rows.columns, F.col("__answer").alias("__told"))
    return rows.mapInArrow(stay, schema).unionAll(answered.mapInArrow(last, schema))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosures: DataFrame | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind), text, clean_text."""
    own = texts(docs, id_col, text_col)
    pairs = staged(disclosing(own) if disclosures is None else disclosures, "pii-pairs")
    span = "array<struct<start:int,stop:int,kind:string>>"
    schema = f"doc_id long, text string, base {span}, spans {span}, clean_text string"

    def kinds(spans: list[Span]) -> list[dict]:
        return [{"start": a, "stop": b, "kind": k} for a, b, k in spans]

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, known in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "__told")], strict=True):
            text = text or ""
            spans = every_span(text, known)
            out.append({"doc_id": doc_id, "text": text, "base": kinds([s for s in spans if s[2] in KINDS]), "spans": kinds(spans), "clean_text": generalised(text, spans)})
        return pa.RecordBatch.from_pylist(out, schema=ARROW)

    return told_rows(own, pairs, finish, schema)


def rewritten(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with doc_id and text of its clean_text; null text stays null."""
    pairs = staged(disclosing(texts(docs)), "pii-pairs")
    rows = plain_names(docs)
    names = rows.columns

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        clean = [generalised(t, every_span(t, known)) if t else t for t, known in zip(part.column("text").to_pylist(), part.column("__told").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if f == "text" else part.column(f) for f in names], names=names)

    return told_rows(rows, pairs, finish, rows.schema).toDF(*docs.columns)


TOLD_ARROW = pa.list_(pa.struct([("entity", pa.int64()), ("word", pa.int64())]))
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("base", SPAN), ("spans", SPAN), ("clean_text", pa.string())])


def generalised(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets, removed words by nothing; overlapping spans become one."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], "" if kind == "term" else f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
