"""Rules over one submission's events: each takes events (and what it compares them with) and returns flags
(submission_id, heuristic_id, severity, confidence, session_id or path, place). Thresholds are parameters with the
reference defaults. Range conditions always come with the session as an equal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.lines import shared_hashes, shared_lines
from ..plans.staging import staged
from .checks import SESSION
from .scoring import rank


def flag(rows: DataFrame, rule: str, severity: Column, confidence: Column, *keep: str) -> DataFrame:
    return rows.select("submission_id", F.lit(rule).alias("heuristic_id"), severity.alias("severity"), F.round(confidence, 6).alias("confidence"), *keep)


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def paste_candidates(events: DataFrame) -> DataFrame:
    """Pastes, and deltas of changes that a paste made, numbered within the submission before any choice of paths.

    deltas: array of texts; source: 'paste' marks changes that a paste made; content: a paste's own text.
    """
    pastes = events.where("kind = 'paste'").select("submission_id", "session_id", "global_idx", F.lit(0).alias("ord"), "path", F.col("content").alias("text"))
    changes = events.where("kind = 'doc.change' and source = 'paste'").select("submission_id", "session_id", "global_idx", F.posexplode("deltas").alias("ord", "text"), "path").select(pastes.columns)
    w = W.partitionBy("submission_id").orderBy("global_idx", "ord")
    return pastes.unionAll(changes).withColumn("nth", (F.row_number().over(w) - 1).cast("long"))


def large_pastes(candidates: DataFrame, anomalies: DataFrame, moves: DataFrame | None = None, chars: int = 200, lines: int = 10, high_chars: int = 500, high_lines: int = 30, near_ms: int = 5000) -> DataFrame:
    """Candidates (t, place, n_chars, n_lines) that are long; less sure within near_ms of an anomaly of the session, and only
    info for internal moves (submission_id, place)."""
    names = [*SESSION, "t", "place", "n_chars", "n_lines"]
    rows = candidates.where((F.col("n_chars") >= chars) | (F.col("n_lines") >= lines)).select(*names, F.lit(0).alias("anomaly"))
    rows = rows.unionByName(anomalies.select(*SESSION, "t", F.lit(1).alias("anomaly")), allowMissingColumns=True)
    w = W.partitionBy(*SESSION).orderBy("t").rangeBetween(-near_ms, near_ms)
    big = rows.withColumn("near", F.max("anomaly").over(w) == 1).where("anomaly = 0")
    big = big.withColumn("moved", F.lit(None).cast("boolean")) if moves is None else big.join(moves.select("submission_id", "place", F.lit(True).alias("moved")).distinct(), ["submission_id", "place"], "left")
    severity = F.when(F.col("moved"), "info").when((F.col("n_chars") >= high_chars) | (F.col("n_lines") >= high_lines), "high").otherwise("medium")
    return flag(big, "large_paste", severity, F.when(F.col("near"), 0.6).otherwise(0.8), "session_id", "place")


def external_edits(changes: DataFrame, gap_ms: int = 2000, high: int = 100) -> DataFrame:
    """External changes without explanation, runs of one session and file at most gap_ms apart as one.

    changes: diff_size; explanation (formatter or git: the change is explained) unless overridden is true.
    """
    w = W.partitionBy(*SESSION, "path").orderBy("t", "place")
    c = changes.where(~F.coalesce(F.col("explanation").isin("formatter", "git"), F.lit(False)) | F.coalesce("overridden", F.lit(False)))
    c = c.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap_ms).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = c.groupBy(*SESSION, "path", "run").agg(F.min("place").alias("place"), F.max(F.abs("diff_size")).alias("diff"), F.count(F.lit(1)).alias("edits"), F.count_if("overridden").alias("overridden"))
    return flag(g, "external_edits", F.when(F.col("diff") > high, "high").otherwise("medium"), F.lit(0.9), "session_id", "path", "place", "edits", "overridden")


def between_sessions(ranges: DataFrame, ends: DataFrame, starts: DataFrame, high: int = 100) -> DataFrame:
    """Files whose first content in a session differs from the last in the session before, with time between them; high if
    their lengths are more than ``high`` apart.

    ranges: session_id, start_ms, stop_ms, contributor (null: unknown); ends and starts: session_id, path, sha, length.
    """
    w = W.partitionBy("submission_id").orderBy("start_ms", "session_id")
    pairs = ranges.withColumn("next", F.lead("session_id").over(w)).withColumn("next_start", F.lead("start_ms").over(w)).withColumn("next_by", F.lead("contributor").over(w))
    pairs = pairs.where("next is not null and next_start > stop_ms and (contributor is null or next_by is null or contributor = next_by)").select(*SESSION, "next")
    after = starts.select("submission_id", F.col("session_id").alias("next"), "path", F.col("sha").alias("after"), F.col("length").alias("length_after"))
    j = pairs.join(ends.select(*SESSION, "path", F.col("sha").alias("before"), "length"), list(SESSION)).join(after, ["submission_id", "next", "path"])
    severity = F.when(F.abs(F.col("length_after") - F.col("length")) > high, "high").otherwise("medium")
    return flag(j.where("before <> after"), "inter_session_external_change", severity, F.lit(0.85), "session_id", "next", "path")


def low_typing(files: DataFrame, ratio: float = 3.0, high: float = 5.0) -> DataFrame:
    """Files (typed, start_len, final_len, merged, tainted) that grew by far more than was typed."""
    delta = F.col("final_len") - F.col("start_len") - F.col("merged")
    f = files.where("not tainted").withColumn("delta", delta).where("delta > 0")
    f = f.withColumn("ratio", F.when(F.col("typed") > 0, F.col("delta") / F.col("typed")))
    f = f.where(F.col("ratio").isNull() | (F.col("ratio") >= ratio))
    sure = F.least(F.lit(1.0), F.when(F.col("typed") == 0, F.col("delta") / 500).otherwise(F.col("typed") / 500))
    return flag(f, "low_typing_high_output", F.when(F.col("ratio").isNull() | (F.col("ratio") >= high), "high").otherwise("medium"), sure, "path")


def first_save_anomaly(events: DataFrame, limit_ms: int = 30000, chars: int = 500) -> DataFrame:
    """Opens whose first later save of the file in the session comes in under limit_ms with more than chars new ones."""
    w = W.partitionBy(*SESSION, "path").orderBy("t", "place").rowsBetween(1, W.unboundedFollowing)
    save = F.first(F.when(F.col("kind") == "doc.save", F.struct("t", "new_chars")), True).over(w)
    o = events.withColumn("save", save).where("kind = 'doc.open' and save is not null")
    o = o.where((F.col("save.t") - F.col("t") < limit_ms) & (F.col("save.new_chars") > chars))
    return flag(o, "time_to_first_save_anomaly", F.lit("high"), F.lit(0.8), "session_id", "path", "place")


def idle_then_complete(events: DataFrame, idle_ms: int = 600000, within_ms: int = 60000) -> DataFrame:
    """Saves that hold the final content of a file less than half of which stood before a long heartbeat gap.

    events: kind, t, len and sha of the file's content, final_len, final_sha (null on heartbeats). The latest gap before a
    save and the last state before the gap come from windows; no times are joined.
    """
    beat = F.when(F.col("kind") == "session.heartbeat", F.col("t"))
    w = W.partitionBy(*SESSION).orderBy("t")
    before = F.max(beat).over(w.rangeBetween(W.unboundedPreceding, -1))
    e = events.withColumn("gap", F.when(beat - before > idle_ms, F.struct(F.col("t").alias("t1"), before.alias("t0"))))
    e = e.withColumn("gap", F.max("gap").over(w.rangeBetween(W.unboundedPreceding, 0)))
    hit = (F.col("kind") == "doc.save") & (F.col("sha") == F.col("final_sha")) & (F.col("t") <= F.col("gap.t1") + within_ms)
    state = e.where("path is not null and kind <> 'session.heartbeat'")
    names = [*SESSION, "path", "place", "final_len"]
    asked = state.where(hit).select(*names, F.col("gap.t0").alias("t"), F.lit(None).cast(events.schema["len"].dataType).alias("len"), F.lit(1).alias("asked"))
    rows = state.select(*names, "t", "len", F.lit(0).alias("asked")).unionAll(asked)
    last = F.max(F.when(F.col("asked") == 0, F.struct("t", "place", "len"))).over(W.partitionBy(*SESSION, "path").orderBy("t").rangeBetween(W.unboundedPreceding, 0))
    j = rows.withColumn("before_len", last["len"]).where("asked = 1 and before_len < 0.5 * final_len")
    return flag(j, "idle_then_complete", F.lit("high"), F.lit(0.8), "session_id", "path", "place")


def no_errors(events: DataFrame, least: int = 5) -> DataFrame:
    """Submissions with a terminal, file activity and several commands (exit_code) that all succeeded. Where a session's
    terminal hid its results (integrated is false), an info flag for each such session instead."""
    kind = F.col("kind")
    s = events.groupBy(*SESSION).agg(
        F.count_if((kind == "terminal.command") & F.col("exit_code").isNotNull()).alias("n"),
        F.count_if((kind == "terminal.command") & (F.col("exit_code") != 0)).alias("failed"),
        F.count_if(kind == "terminal.open").alias("terminals"),
        F.count_if(kind.isin("doc.save", "doc.change", "paste")).alias("active"),
        F.count_if((kind == "terminal.open") & ~F.col("integrated")).alias("hidden"),
    )
    info = flag(s.where("hidden > 0"), "no_intermediate_errors", F.lit("info"), F.lit(1.0), "session_id")
    g = s.groupBy("submission_id").agg(*[F.sum(c).alias(c) for c in ("n", "failed", "terminals", "active", "hidden")])
    clean = g.where(f"hidden = 0 and terminals > 0 and active > 0 and failed = 0 and n >= {least}").withColumn("session_id", F.lit(None).cast("string"))
    return info.unionAll(flag(clean, "no_intermediate_errors", F.lit("medium"), F.lit(0.65), "session_id"))


def known_sources(pastes: DataFrame, corpus: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Pastes (submission_id, place, sha256, content) that are an entry of the corpus (name, sha256), or share at least
    ``ratio`` of their lines with a block (block: text) of an entry that they are not; one flag for each entry.

    Exact ones are an equal join. Texts are keyed by a digest, and only the hashes of their lines move between tasks.
    """
    p = staged(pastes.select("submission_id", "place", "sha256", F.when(F.col("content") != "", _digest("content")).alias("key")), "paste-keys")
    exact = p.join(corpus.select("name", "sha256").distinct(), "sha256")
    texts = pastes.where("content <> ''").select(_digest("content").alias("key"), F.col("content").alias("text"))
    blocks = corpus.where("block is not null and block <> ''").withColumn("key", _digest("block"))
    found = line_matches(texts, blocks.select("name", "key", F.col("block").alias("text")), ratio)
    fuzzy = p.select("submission_id", "place", "key").join(found, "key").select("submission_id", "place", "name").distinct()
    fuzzy = fuzzy.join(exact.select("submission_id", "place", "name"), ["submission_id", "place", "name"], "left_anti")
    rule = "paste_matches_known_source"
    return flag(exact, rule, F.lit("high"), F.lit(0.95), "place", "name").unionAll(flag(fuzzy, rule, F.lit("medium"), F.lit(0.8), "place", "name"))


def _digest(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def line_matches(texts: DataFrame, blocks: DataFrame, ratio: float) -> DataFrame:
    """(key, name): texts (key, text) whose common lines in order with a block (name, key, text) of that name are at least
    ``ratio`` of the longer one's. Lines keep their newline.

    A line is two hashes of different seeds. Of two texts that match, each lacks ``spare`` of its lines at most, so they share
    one of the spare + 1 rarest of both. A text is compared with one block for each such line and name first, and with the
    others of a name only if that one doesn't match: copies of a block don't meet pair by pair.
    """

    def lined(rows: DataFrame, a: bool) -> DataFrame:
        lines = F.transform(F.filter(F.split("text", "(?<=\n)"), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g")))
        return rows.select("key", F.size(F.split("text", "\n")).alias("size"), lines.alias("lines"), F.lit(a).alias("a"), F.lit(not a).alias("b"))

    every = lined(texts, True).unionAll(lined(blocks, False)).groupBy("key").agg(F.first("size").alias("size"), F.first("lines").alias("lines"), F.max("a").alias("a"), F.max("b").alias("b"))
    every = staged(every.select("key", "size", "lines.h", "lines.g", "a", "b"), "lines")
    names = staged(blocks.select("key", "name").distinct(), "names")
    same = every.where("a and b").where(F.size("h") / F.col("size") >= ratio).select("key").join(names, "key")

    df = every.select(F.explode(F.array_distinct("h")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = every.select("key", "size", F.size("h").alias("n"), "a", "b", F.explode("h").alias("line")).join(df, "line")
    own = W.partitionBy("key")
    # Lines that stand in one text only are the rarest, and never shared.
    spare = F.col("n") - F.ceil(ratio * F.col("size") - 1e-9)
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    rare = met.withColumn("rank", alone + F.row_number().over(own.orderBy("df", "line"))).where(F.col("rank") <= spare + 1)
    rare = staged(rare.select("key", "size", "line", "a", "b").distinct(), "rare-lines")

    like = (F.col("key") != F.col("other")) & (F.least("size", "osize") >= ratio * F.greatest("size", "osize"))
    held = rare.where("b").join(names, "key").select("line", "name", F.col("key").alias("other"), F.col("size").alias("osize"))
    one = held.groupBy("line", "name").agg(F.min(F.struct("other", "osize")).alias("o"), (F.count(F.lit(1)) > 1).alias("more")).select("line", "name", "o.*", "more")
    first = staged(rare.where("a").select("key", "size", "line").join(one, "line"), "first-blocks")

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.where(like).select("key", "name", "other").distinct(), "line-pairs")
        side = lambda key, x: every.select(F.col("key").alias(key), F.col("size").alias(f"s{x}"), F.col("h").alias(f"h{x}"), F.col("g").alias(f"g{x}"))
        both = pairs.select("key", "other").distinct().join(side("key", "a").hint("merge"), "key").join(side("other", "b").hint("merge"), "other")
        hits = both.where(shared_hashes("ha", "ga", "hb", "gb") / F.greatest("sa", "sb") >= ratio).select("key", "other")
        return pairs.join(hits, ["key", "other"]).select("key", "name").distinct()

    hits = staged(same.unionAll(judged(first)).distinct(), "line-hits")
    open_ = first.where("more").select("key", "size", "line", "name").join(hits.select(F.col("key").alias("of"), F.col("name").alias("hit")), (F.col("key") == F.col("of")) & F.col("name").eqNullSafe(F.col("hit")), "left_anti")
    rest = open_.join(held.select(F.col("line").alias("at"), F.col("name").alias("entry"), "other", "osize"), (F.col("line") == F.col("at")) & F.col("name").eqNullSafe(F.col("entry")))
    return hits.unionAll(judged(rest))


def pastes_of_solution(pastes: DataFrame, moves: DataFrame | None = None, coverage: float = 0.8, lines: int = 10) -> DataFrame:
    """Pastes (submission_id, place, content, final: the file's final content) that make up most of the final file; only
    info for internal moves (submission_id, place)."""
    p = pastes.where("content <> '' and final <> ''").withColumn("shared", shared_lines("content", "final"))
    hits = p.where((F.col("shared") >= lines) & (F.col("shared") >= coverage * F.size(F.split("final", "\n"))))
    hits = hits.withColumn("moved", F.lit(None).cast("boolean")) if moves is None else hits.join(moves.select("submission_id", "place", F.lit(True).alias("moved")).distinct(), ["submission_id", "place"], "left")
    return flag(hits, "paste_is_solution", F.when(F.col("moved"), "info").otherwise("high"), F.lit(0.85), "place")


def corpus_errors(entries: DataFrame) -> DataFrame:
    """index, error of corpus entries (index, name, sha256, lines)."""
    error = F.when(F.col("name").isNull() | (F.trim("name") == ""), "no_name").when(F.col("sha256").isNotNull() & ~F.col("sha256").rlike("^[0-9a-f]{64}$"), "bad_hash").when(F.col("sha256").isNull() & (F.coalesce(F.size("lines"), F.lit(0)) == 0), "empty")
    return entries.select("index", error.alias("error")).where("error is not null")


#: Extensions known for generated code, and name parts that suggest it.
AI_EXTENSIONS = (
    "github.copilot", "github.copilot-chat", "github.copilot-labs",
    "anysphere.cursor-always-local",
    "codeium.codeium", "codeium.codeium-enterprise-updater", "codeium.windsurf",
    "exafunction.windsurf",
    "anthropic.claude-code",
    "saoudrizwan.claude-dev",
    "rooveterinaryinc.roo-cline",
    "continue.continue",
    "tabnine.tabnine-vscode", "tabnine.tabnine-enterprise",
    "sourcegraph.cody-ai",
    "amazonwebservices.amazon-q-vscode", "amazonwebservices.aws-toolkit-vscode",
    "blackboxapp.blackbox", "blackboxapp.blackboxagent",
    "danielsanmedium.dscodegpt",
    "supermaven.supermaven",
    "tabbyml.vscode-tabby",
    "aminer.codegeex",
    "aixcoder.aixcoder",
    "askcodi.askcodi",
    "bito.bito",
    "double-bot.double-bot",
    "mutable-ai.mutable-ai",
    "visualstudioexptteam.vscodeintellicode",
)
AI_TOKENS = ("copilot", "claude", "codeium", "cursor", "tabnine", "cody", "codewhisperer", "codegpt", "blackbox", "supermaven", "aixcoder", "codegeex", "tabby", "windsurf", "ai", "gpt", "llm")


def ai_extensions(seen: DataFrame) -> DataFrame:
    """First sight per session of an extension on the list, or with a telling name part."""
    token = F.arrays_overlap(F.split(F.lower("extension"), "[._-]"), F.array(*map(F.lit, AI_TOKENS)))
    e = seen.withColumn("sure", F.when(F.lower("extension").isin(*AI_EXTENSIONS), 0.9).when(token, 0.6)).where("sure is not null")
    g = e.groupBy(*SESSION, "extension").agg(F.min("place").alias("place"), F.max("sure").alias("sure"))
    return flag(g, "ai_extension_active", F.lit("info"), F.col("sure"), "session_id", "extension", "place")


def shell_integration_off(terminals: DataFrame) -> DataFrame:
    return flag(terminals.where("not integrated"), "shell_integration_disabled", F.lit("info"), F.lit(1.0), "session_id", "place")


def extension_set_changes(activated: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Extensions activated in a session whose snapshots don't hold them."""
    new = activated.join(snapshots.select(*SESSION, "extension"), [*SESSION, "extension"], "left_anti").groupBy(*SESSION, "extension").agg(F.min("place").alias("place"))
    return flag(new, "extension_set_changed_mid_assignment", F.lit("medium"), F.lit(0.85), "session_id", "extension", "place")


def terminal_during_external_change(events: DataFrame) -> DataFrame:
    """External changes with a terminal open at or before them: one running minimum, no join."""
    w = W.partitionBy(*SESSION)
    first = F.min(F.when(F.col("kind") == "terminal.open", F.col("t"))).over(w)
    e = events.withColumn("first", first).where("kind = 'fs.external_change' and first <= t")
    return flag(e, "terminal_active_during_external_change", F.lit("info"), F.lit(0.6), "session_id", "place")


def clock_jumps(skews: DataFrame, limit_ms: int = 300000, least: int = 2) -> DataFrame:
    g = skews.groupBy(*SESSION).agg(F.max(F.abs("delta_ms")).alias("most"), F.count(F.lit(1)).alias("n"), F.max_by("delta_ms", F.struct(F.abs("delta_ms"), "delta_ms")).alias("delta_ms"))
    g = g.where((F.col("most") > limit_ms) | (F.col("n") >= least))
    return flag(g, "clock_jumps", F.lit("medium"), F.lit(0.8), "session_id", "delta_ms")


def heartbeat_gaps(events: DataFrame, interval_ms: int = 30000, least_ms: int = 300000, edge_ms: int = 1000) -> DataFrame:
    """Gaps of wall time (ms) between heartbeats with other events inside, apart from the edges, and no session end.

    Every event meets the heartbeats around it in two windows; a gap is then a group of events.
    """
    limit = max(least_ms, 10 * interval_ms)
    w = W.partitionBy(*SESSION).orderBy("place")
    beat = F.when(F.col("kind") == "session.heartbeat", F.struct("place", "ms"))
    e = events.withColumn("a", F.last(beat, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("b", F.first(beat, True).over(w.rowsBetween(1, W.unboundedFollowing)))
    inside = (F.col("ms") > F.col("a.ms") + edge_ms) & (F.col("ms") < F.col("b.ms") - edge_ms)
    g = e.where(f"kind <> 'session.heartbeat' and b.ms - a.ms > {limit}").groupBy(*SESSION, F.col("a.place").alias("place")).agg(F.count_if(inside).alias("inside"), F.count_if(F.col("kind") == "session.end").alias("ends"))
    return flag(g.where("inside > 0 and ends = 0"), "gap_in_heartbeats", F.lit("medium"), F.lit(0.75), "session_id", "place")


def session_overlap_flags(pairs: DataFrame) -> DataFrame:
    """Flags of overlaps judged decided ('multi_machine') or unknown."""
    p = pairs.where(F.col("judgement").isin("multi_machine", "unknown"))
    decided = F.col("judgement") == "multi_machine"
    return flag(p, "multiple_sessions_overlap", F.when(decided, "high").otherwise("low"), F.when(decided, 0.95).otherwise(0.5), "session_a", "session_b")


def extension_hash_mismatch(observed: DataFrame, allowed: DataFrame) -> DataFrame:
    return flag(observed.select("submission_id", "extension_hash").distinct().join(allowed, "extension_hash", "left_anti"), "extension_hash_mismatch", F.lit("medium"), F.lit(0.9), "extension_hash")


def merged_and_written(runs: DataFrame, merges: DataFrame) -> DataFrame:
    """Characters by origin (submission_id, path, event_seq, length): from merge events, and typed after the first of them."""
    m = merges.select("submission_id", F.col("global_idx").alias("event_seq"), F.lit(True).alias("merged"))
    first = merges.groupBy("submission_id").agg(F.min("global_idx").alias("first"))
    j = runs.join(m, ["submission_id", "event_seq"], "left").join(first, "submission_id", "left")
    return j.groupBy("submission_id", "path").agg(
        F.coalesce(F.sum(F.when(F.col("merged"), F.col("length"))), F.lit(0)).alias("merged_in"),
        F.coalesce(F.sum(F.when(F.col("merged").isNull() & (F.col("event_seq") > F.col("first")), F.col("length"))), F.lit(0)).alias("written_after"),
    )


def reviewed_only(rows: DataFrame, reviewed: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows of reviewed paths; submissions without a trusted manifest keep all rows."""
    t = trusted.select("submission_id", F.lit(True).alias("trusted")).distinct()
    r = reviewed.select("submission_id", "path", F.lit(True).alias("reviewed")).distinct()
    j = rows.join(t, "submission_id", "left").join(r, ["submission_id", "path"], "left")
    return j.where("trusted is null or reviewed").drop("trusted", "reviewed")


def capture_gate(flags: DataFrame, policy: DataFrame, terminal_rules: list[str]) -> DataFrame:
    """Without the terminal rules' flags where a verified policy turned the signal off."""
    off = policy.where("verified and not terminal").select("submission_id", F.lit(True).alias("off")).distinct()
    return flags.join(off, "submission_id", "left").where(F.col("off").isNull() | ~F.col("heuristic_id").isin(*terminal_rules)).drop("off")


def in_order(flags: DataFrame) -> DataFrame:
    """place_in_report: by severity, confidence, first key, id."""
    w = W.partitionBy("submission_id").orderBy(F.desc(rank("severity")), F.desc("confidence"), "first_key", "heuristic_id")
    return flags.withColumn("place_in_report", F.row_number().over(w).cast("long"))
