"""Lists, facets and statistics over a cohort of submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def filtered(subs: DataFrame, *, flags: DataFrame | None = None, without: DataFrame | None = None, search: str | None = None, score: tuple[float, float] | None = None, active_min: tuple[int, int] | None = None, **equal) -> DataFrame:
    """Submissions that meet all conditions given: equal columns (a list means one of), ranges, a search in display_name,
    at least one of ``flags``, none of ``without`` (both by submission_id)."""
    for column, value in equal.items():
        subs = subs.where(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    if search:
        subs = subs.where(contains(F.col("display_name"), search))
    for column, bounds in (("score_total", score), ("active_min", active_min)):
        if bounds:
            subs = subs.where(F.col(column).between(*bounds))
    if flags is not None:
        subs = subs.join(flags.select(F.col("submission_id").alias("id")), "id", "left_semi")
    if without is not None:
        subs = subs.join(without.select(F.col("submission_id").alias("id")), "id", "left_anti")
    return subs


def contains(column: Column, text: str) -> Column:
    """Case-insensitive, with % and _ of the text meaning themselves."""
    plain = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{plain}%")


def page(rows: DataFrame, order: list[tuple[str, bool]], after: list | None, limit: int) -> DataFrame:
    """A page in order of (column, descending) after the key of the last row seen, plus one row that tells there is more.

    Null is the smallest value: first in ascending order, last in descending order, and a key may hold it.
    """
    if after is not None:
        later = F.lit(False)
        same = F.lit(True)
        for (column, desc), value in zip(order, after, strict=True):
            if value is None:
                beyond = F.lit(False) if desc else F.col(column).isNotNull()
            else:
                beyond = (F.col(column) < value) | F.col(column).isNull() if desc else F.col(column) > value
            later = later | (same & F.coalesce(beyond, F.lit(False)))
            same = same & F.col(column).eqNullSafe(F.lit(value))
        rows = rows.where(later)
    return rows.orderBy(*[F.desc_nulls_last(c) if d else F.asc_nulls_first(c) for c, d in order]).limit(limit + 1)


def enriched(subs: DataFrame, assignments: DataFrame, roster: DataFrame, contributors: DataFrame) -> DataFrame:
    """Rows with assignment (must exist), student (may) and the list of contributors."""
    c = contributors.groupBy(F.col("submission_id").alias("id")).agg(F.sort_array(F.collect_set("contributor_key")).alias("contributors"))
    students = roster.select(F.col("id").alias("student_id"), "display_name")
    return subs.join(assignments, "assignment_id").join(students, "student_id", "left").join(c, "id", "left")


def student_rollup(live: DataFrame, chosen: DataFrame, flags: DataFrame) -> DataFrame:
    """Per student over the chosen submissions; flags are counted over all live ones."""
    s = chosen.groupBy("student_id").agg(F.countDistinct("id").alias("submissions"), F.round(F.sum("score_total"), 6).alias("score_sum"), F.max("score_total").alias("score_max"), F.max(F.struct("score_total", "id"))["id"].alias("worst"))
    f = live.join(flags.withColumnRenamed("submission_id", "id"), "id").groupBy("student_id").agg(F.count(F.lit(1)).alias("flags"))
    return s.join(f, "student_id", "left").select("student_id", "submissions", "score_sum", "score_max", "worst", F.coalesce("flags", F.lit(0)).alias("flags"))


#: Recompute states from the best to the worst.
RECOMPUTE = ("fresh", "stale", "recomputing", "error")
#: Sort orders of the student list: (column, descending), each with the student as its last key.
STUDENT_ORDERS = {"score_sum_desc": [("score_sum", True), ("student_id", False)], "score_max_desc": [("score_max", True), ("student_id", False)], "student_asc": [("display_name", False), ("student_id", False)]}


def student_page(rollup: DataFrame, chosen: DataFrame, roster: DataFrame, order: str, after: list | None, limit: int) -> DataFrame:
    """A page of the student rollup in one of STUDENT_ORDERS, with the student's name and the worst recompute state of the chosen
    submissions (``recompute_status``); a state that isn't known counts as the best."""
    place = F.greatest(F.array_position(F.array(*map(F.lit, RECOMPUTE)), F.coalesce("recompute_status", F.lit(RECOMPUTE[0]))), F.lit(1))
    worst = chosen.groupBy("student_id").agg(F.max(place).cast("int").alias("nr"))
    status = F.element_at(F.array(*map(F.lit, RECOMPUTE)), F.col("nr")).alias("recompute_status")
    names = roster.select(F.col("id").alias("student_id"), "display_name")
    rows = rollup.join(worst, "student_id").join(names, "student_id", "left").select(*rollup.columns, "display_name", status)
    return page(rows, STUDENT_ORDERS[order], after, limit)


def facets(subs: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """facet, value, n: each column's counts under the other columns' choices, in one pass over the submissions."""
    match = {c: F.col(c).isin(v) if v else F.lit(True) for c, v in chosen.items()}
    pairs = []
    for c in chosen:
        others = F.lit(True)
        for d in chosen:
            if d != c:
                others = others & match[d]
        pairs.append(F.when(others, F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))))
    return subs.select(F.explode(F.array_compact(F.array(*pairs))).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def assignment_stats(assignments: DataFrame, subs: DataFrame) -> DataFrame:
    """Counts and score figures of every assignment, zeros for those without submissions. Median and p95 are exact."""
    g = subs.groupBy("assignment_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("student_id").alias("students"), F.round(F.avg("score_total"), 6).alias("mean"),
        F.round(F.percentile("score_total", 0.5), 6).alias("median"), F.round(F.percentile("score_total", 0.95), 6).alias("p95"),
        F.count_if(F.col("validation_status") == "fail").alias("fails"), F.count_if(F.col("validation_status") == "warn").alias("warns"),
    )
    return assignments.join(g, "assignment_id", "left").na.fill(0)


def summary(subs: DataFrame, roster: DataFrame, counts: DataFrame, files: DataFrame) -> DataFrame:
    """One row per submission: student, severity counts and number of files."""
    f = files.groupBy(F.col("submission_id").alias("id")).agg(F.countDistinct("path").alias("files"))
    s = subs.join(roster.select(F.col("id").alias("student_id"), "display_name"), "student_id", "left").join(counts.withColumnRenamed("submission_id", "id"), "id", "left").join(f, "id", "left")
    return s.na.fill(0)


def by_session(supporting: DataFrame) -> DataFrame:
    """flag_id, session_id, places, and how many sessions the flag spans."""
    g = supporting.groupBy("flag_id", "session_id").agg(F.sort_array(F.collect_list("global_idx")).alias("places"))
    return g.withColumn("sessions", F.count(F.lit(1)).over(W.partitionBy("flag_id")))


def anonymised(roster: DataFrame) -> DataFrame:
    """Names by protected index, or by the start of the id's hash where there is none; nothing else personal stays."""
    stub = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 6)
    label = F.coalesce(F.col("protected_index").cast("string"), stub)
    return roster.select("id", F.concat(F.lit("Student "), label).alias("display_name"), F.concat(F.lit("S "), label).alias("sid"), F.lit(None).cast("string").alias("email"))


def protected_indices(roster: DataFrame, seed: str) -> DataFrame:
    """Numbers rows without an index after the largest one of their semester, in an order only the seed tells."""
    most = F.coalesce(F.max("protected_index").over(W.partitionBy("semester_id")), F.lit(0))
    nth = F.row_number().over(W.partitionBy("semester_id", F.col("protected_index").isNull()).orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)))
    return roster.select("id", "semester_id", F.coalesce("protected_index", most + nth).cast("long").alias("protected_index"))
