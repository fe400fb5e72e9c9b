"""Scores from flags, and what another configuration would change. Rule tables are small and fixed: one row for each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Severities in rising order with their weights.
SEVERITIES = ("info", "low", "medium", "high")
WEIGHTS = (0, 1, 3, 8)


def rank(severity: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity) if isinstance(severity, str) else severity).cast("int") - 1


def severity_of(place: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), place)


def scored_flags(flags: DataFrame, config: DataFrame) -> DataFrame:
    """Flags of enabled rules with their score; rules without an entry are enabled with weight 1."""
    c = config.select("heuristic_id", "enabled", "weight")
    f = flags.join(c, "heuristic_id", "left").where(F.coalesce("enabled", F.lit(True)))
    base = F.get(F.array(*map(F.lit, WEIGHTS)), rank("severity"))
    return f.withColumn("flag_score", base * F.col("confidence") * F.coalesce("weight", F.lit(1.0))).drop("enabled", "weight")


def submission_scores(submissions: DataFrame, scored: DataFrame) -> DataFrame:
    """Every submission's sum of scores and highest severity; info without flags."""
    s = scored.groupBy(F.col("submission_id").alias("id")).agg(F.sum("flag_score").alias("score"), F.max(rank("severity")).alias("most"))
    return submissions.join(s, "id", "left").withColumn("score_total", F.round(F.coalesce("score", F.lit(0.0)), 6)).withColumn("score_max_severity", severity_of(F.coalesce("most", F.lit(0)))).drop("score", "most")


def supporting(flags: DataFrame, index: DataFrame) -> DataFrame:
    """Flags (flag_id, submission_id, keys array of session:seq) with the places of their events and the one session, or ''."""
    e = flags.select("flag_id", "submission_id", F.explode("keys").alias("key"))
    i = index.select("submission_id", F.concat_ws(":", "session_id", F.col("seq").cast("string")).alias("key"), "session_id", "global_idx")
    g = e.join(i, ["submission_id", "key"]).groupBy("flag_id").agg(F.sort_array(F.collect_list("global_idx")).alias("places"), F.min("session_id").alias("a"), F.max("session_id").alias("b"))
    return g.select("flag_id", "places", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("").alias("session_id"))


def severity_counts(flags: DataFrame, *keys: str) -> DataFrame:
    return flags.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])


def top_flags(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n flags of each submission that come first by severity, then confidence."""
    w = W.partitionBy("submission_id").orderBy(F.desc(rank("severity")), F.desc("confidence"), "line")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def contributor_scores(scored: DataFrame, contributors: DataFrame) -> DataFrame:
    """Each contributor's own flags; a submission's only contributor owns all of them."""
    alone = contributors.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("submission_id")))
    j = alone.join(scored.withColumnRenamed("contributor_key", "flag_key"), "submission_id", "left")
    own = (F.col("n") == 1) | (F.col("flag_key") == F.col("contributor_key"))
    g = j.groupBy("submission_id", "contributor_key").agg(F.sum(F.when(own, F.col("flag_score"))).alias("s"), F.count_if(own & F.col("flag_score").isNotNull()).alias("flags"), F.max(F.when(own, rank("severity"))).alias("most"))
    return g.select("submission_id", "contributor_key", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score_total"), "flags", severity_of(F.coalesce("most", F.lit(0))).alias("max_severity"))


def normalised_config(config: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("heuristic_id").join(config, "heuristic_id", "left").select("heuristic_id", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def config_errors(config: DataFrame, known: DataFrame) -> DataFrame:
    """heuristic_id, error: the first thing wrong with an entry."""
    k = known.select("heuristic_id", F.lit(True).alias("known"))
    n = F.count(F.lit(1)).over(W.partitionBy("heuristic_id"))
    c = config.withColumn("n", n).join(k, "heuristic_id", "left")
    error = F.when(F.col("known").isNull(), "unknown_rule").when(F.col("n") > 1, "twice").when(F.col("weight").isNull() | F.isnan("weight"), "no_weight").when(F.col("weight") < 0, "negative_weight").when(F.col("weight") > 3.5, "weight_too_large")
    return c.select("heuristic_id", error.alias("error")).where("error is not null").distinct()


def version_history(configs: DataFrame) -> DataFrame:
    """Versions of each semester's configuration, the newest first, and which is in force."""
    w = W.partitionBy("semester_id").orderBy(F.desc("version"))
    return configs.withColumn("place", F.row_number().over(w).cast("long")).withColumn("active", F.col("place") == 1)


def score_changes(submissions: DataFrame, flags: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new score and highest severity of every submission. The flags are read once: both scores are sums of one pass."""
    both = old.select("heuristic_id", F.col("enabled").alias("e0"), F.col("weight").alias("w0")).join(new.select("heuristic_id", F.col("enabled").alias("e1"), F.col("weight").alias("w1")), "heuristic_id", "full")
    f = flags.join(both, "heuristic_id", "left")
    base = F.get(F.array(*map(F.lit, WEIGHTS)), rank("severity")) * F.col("confidence")
    out = []
    for i, name in enumerate(("old", "new")):
        on = F.coalesce(f"e{i}", F.lit(True))
        out += [F.sum(F.when(on, base * F.coalesce(f"w{i}", F.lit(1.0)))).alias(f"{name}_score"), F.max(F.when(on, rank("severity"))).alias(f"{name}_most")]
    s = submissions.join(f.groupBy(F.col("submission_id").alias("id")).agg(*out), "id", "left")
    for name in ("old", "new"):
        s = s.withColumn(f"{name}_score", F.round(F.coalesce(f"{name}_score", F.lit(0.0)), 6)).withColumn(f"{name}_severity", severity_of(F.coalesce(f"{name}_most", F.lit(0)))).drop(f"{name}_most")
    return s


def movers(changes: DataFrame, n: int = 20) -> DataFrame:
    d = F.round(F.col("new_score") - F.col("old_score"), 6)
    return changes.select("id", "old_score", "new_score", d.alias("delta")).orderBy(F.desc(F.abs("delta")), "id").limit(n)


def histogram(changes: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Counts in equal buckets up to the largest score, at least 1; the last bucket is closed. All buckets are returned."""
    most = changes.agg(F.greatest(F.lit(1.0), F.max(column)).alias("most"))
    b = changes.crossJoin(F.broadcast(most)).groupBy(F.least(F.floor(F.col(column) / (F.col("most") / buckets)), F.lit(buckets - 1)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # one row
    spine = changes.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    return spine.join(b, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def config_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """heuristic_id, change: modified, or reenabled."""
    j = old.select("heuristic_id", F.col("enabled").alias("e0"), F.col("weight").alias("w0")).join(new.select("heuristic_id", F.col("enabled").alias("e1"), F.col("weight").alias("w1")), "heuristic_id", "full")
    e0, e1 = F.coalesce("e0", F.lit(True)), F.coalesce("e1", F.lit(True))
    change = F.when(~e0 & e1, "reenabled").when((e0 != e1) | (F.coalesce("w0", F.lit(1.0)) != F.coalesce("w1", F.lit(1.0))), "modified")
    return j.select("heuristic_id", change.alias("change")).where("change is not null")


def fast_path(old: DataFrame, new: DataFrame) -> DataFrame:
    """eligible: stored flags suffice, since no rule is enabled that wasn't."""
    d = config_diff(old, new)
    return d.agg((F.count_if(F.col("change") == "reenabled") == 0).alias("eligible"), F.count(F.lit(1)).alias("changed"))


def job_state(items: DataFrame, key: str, ok: str, failed: str) -> DataFrame:
    """Counts of a job's items and its state from them: running, succeeded, failed or partial."""
    g = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == ok).alias("n_ok"), F.count_if(F.col("status") == failed).alias("n_failed"))
    state = F.when(F.col("n_ok") + F.col("n_failed") < F.col("n"), "running").when(F.col("n_failed") == 0, "succeeded").when(F.col("n_ok") == 0, "failed").otherwise("partial")
    return g.withColumn("state", state)
