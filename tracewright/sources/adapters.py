"""Inputs of the operators, made from the driver's tables. All rules are deterministic and need no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Which event types stand for which kinds, and the remainders of k that stand for further ones.
KIND_OF_TYPE = {"click": "doc.change", "view": "session.heartbeat", "signup": "doc.open", "purchase": "paste", "error": "fs.external_change"}
KIND_OF_REMAINDER = {0: "clock.skew", 1: "terminal.open", 2: "terminal.command", 3: "focus.change", 4: "git.event"}
FIRST_MS, WEEK_MS = 1704067200000, 604800000


def chosen(column: Column, values: dict, otherwise: Column | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = (F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v)))
    return out if otherwise is None else out.otherwise(otherwise)


class Tables:
    """The driver's tables of one folder, as they are and as operator inputs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from ..plans.staging import on_workers

        on_workers(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def plain_events(self) -> DataFrame:
        """Events of user sessions by week: submission_id, session_id, seq, t, ms, wall, kind, k, path, size."""
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        e = self.raw("events").select(
            "event_id", F.col("user_id").alias("submission_id"), us.alias("us"), F.floor(us / 1000).cast("long").alias("ms"), "event_type",
            F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor(F.col("value") * 10).cast("long").alias("size"),
        )
        e = e.withColumn("session_id", F.concat(F.col("submission_id").cast("string"), F.lit("-w"), F.floor((F.col("ms") - FIRST_MS) / WEEK_MS).cast("string")))
        session = W.partitionBy("submission_id", "session_id")
        return e.select(
            "event_id", "submission_id", "session_id",
            (F.row_number().over(session.orderBy("us", "event_id")) - 1).cast("long").alias("seq"),
            (F.col("ms") - F.min("ms").over(session)).alias("t"),
            "ms",
            F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("wall"),
            chosen(F.col("k") % 20, KIND_OF_REMAINDER, chosen(F.col("event_type"), KIND_OF_TYPE)).alias("kind"),
            "k",
            F.concat(F.lit("f"), (F.col("k") % 5).cast("string"), F.lit(".py")).alias("path"),
            "size",
        )

    def events(self) -> DataFrame:
        """plain_events with global_idx."""
        from ..operators.event_index import global_order

        return global_order(self.plain_events())

    def submissions(self) -> DataFrame:
        o = self.raw("orders")
        s = o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % 12).cast("long").alias("assignment_id"),
            chosen(F.col("o_orderstatus"), {"F": "fail", "O": "pass", "P": "warn"}).alias("validation_status"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("ingested_at"), F.col("o_totalprice").alias("price"),
            (F.col("o_orderkey") % 240).cast("long").alias("active_min"),
        )
        return s

    def flags(self) -> DataFrame:
        rf = F.concat("l_returnflag", "l_linestatus")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
            F.concat(F.lit("h"), (F.col("l_partkey") % 28).cast("string")).alias("heuristic_id"),
            chosen(rf, {"RF": "high", "AF": "high", "NF": "medium", "RO": "medium", "NO": "low", "AO": "info"}).alias("severity"),
            F.round(F.col("l_discount") * 10, 2).alias("confidence"), (F.col("l_suppkey") % 4).cast("long").alias("session"),
        )

    def roster(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("sid"), F.col("c_name").alias("display_name"),
            F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org"))).alias("email"),
            F.col("c_nationkey").alias("semester_id"),
        )

    def config(self, candidate: bool = False) -> DataFrame:
        """28 rules: heuristic_id, enabled, weight."""
        n = F.col("n")
        weight = 1 + (n % 3) * 0.5
        if candidate:
            weight = F.when(n % 4 == 0, weight * 2).otherwise(weight)
        return self.spark.range(28).select(F.col("id").alias("n")).select(F.concat(F.lit("h"), n.cast("string")).alias("heuristic_id"), (n % 9 != 0).alias("enabled"), weight.alias("weight"))

    def commits(self) -> DataFrame:
        """node, parent edges of an acyclic graph over the parts."""
        p = F.col("p_partkey")
        e = self.raw("part").select(p.alias("node"), F.explode(F.array(F.floor(p / 2), F.when(p % 5 == 0, F.floor(p / 3)))).alias("parent"))
        return e.where("parent < node").distinct()

    def turns(self) -> DataFrame:
        """Edits of one file per conversation."""
        return self.raw("conversations").select(
            F.col("conv_id").alias("submission_id"), F.col("turn").alias("seq"), chosen(F.col("role"), {"system": "doc.open", "user": "doc.change"}, F.lit("paste")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
        )

    def pastes(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(F.col("source").alias("submission_id"), F.col("doc_id").alias("global_idx"), F.col("text").alias("content"), F.col("n_chars").alias("length"), F.sha2("text", 256).alias("sha256"))


#: The same inputs as DuckDB common table expressions.
def _case(column: str, values: dict, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {column} = {k!r} then {v!r}" for k, v in values.items()) + f" else {otherwise} end"


EVENTS = f"""
e0 as (select event_id, user_id as submission_id, epoch_us(ts) as us, epoch_us(ts) // 1000 as ms, event_type,
    cast(json_extract_string(props, '$.k') as int) as k, cast(floor(value * 10) as bigint) as size from events),
e1 as (select *, submission_id::varchar || '-w' || ((ms - {FIRST_MS}) // {WEEK_MS})::varchar as session_id from e0),
e2 as (select event_id, submission_id, session_id,
    row_number() over (partition by submission_id, session_id order by us, event_id) - 1 as seq,
    ms - min(ms) over (partition by submission_id, session_id) as t, ms,
    strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as wall,
    {_case("k % 20", KIND_OF_REMAINDER, _case("event_type", KIND_OF_TYPE))} as kind,
    k, 'f' || (k % 5)::varchar || '.py' as path, size from e1),
ev as (select *, row_number() over (partition by submission_id order by wall, session_id, seq) - 1 as global_idx from e2)"""
SUBMISSIONS = f"""
subs as (select o_orderkey as id, o_custkey as student_id, o_orderkey % 12 as assignment_id,
    {_case("o_orderstatus", {"F": "fail", "O": "pass", "P": "warn"})} as validation_status,
    strftime(o_orderdate, '%Y-%m-%d') as ingested_at, o_totalprice as price, o_orderkey % 240 as active_min from orders)"""
FLAGS = f"""
flags as (select l_orderkey as submission_id, l_linenumber as line, l_partkey as part, l_suppkey as supp, 'h' || (l_partkey % 28)::varchar as heuristic_id,
    {_case("l_returnflag || l_linestatus", {"RF": "high", "AF": "high", "NF": "medium", "RO": "medium", "NO": "low", "AO": "info"})} as severity,
    round(l_discount * 10, 2) as confidence, l_suppkey % 4 as session from lineitem)"""
ROSTER = """
roster as (select c_custkey as id, c_custkey::varchar as sid, c_name as display_name,
    case when c_custkey % 7 <> 0 then 'u' || c_custkey::varchar || '@example.org' end as email, c_nationkey as semester_id from customer)"""
CONFIG = """
config as (select 'h' || n::varchar as heuristic_id, n % 9 <> 0 as enabled, 1 + (n % 3) * 0.5::double as weight from range(28) r(n)),
candidate as (select 'h' || n::varchar as heuristic_id, n % 9 <> 0 as enabled,
    (1 + (n % 3) * 0.5::double) * case when n % 4 = 0 then 2 else 1 end as weight from range(28) r(n))"""
COMMITS = """
commits as (select distinct node, parent from (
    select p_partkey as node, p_partkey // 2 as parent from part
    union all select p_partkey, p_partkey // 3 from part where p_partkey % 5 = 0) where parent < node)"""
TURNS = """
turns as (select conv_id as submission_id, turn as seq,
    case role when 'system' then 'doc.open' when 'user' then 'doc.change' else 'paste' end as kind, coalesce(text, '') as text from conversations)"""
PASTES = "pastes as (select source as submission_id, doc_id as global_idx, text as content, n_chars as length, sha256(text) as sha256 from documents)"
