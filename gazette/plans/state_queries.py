"""Queries on incremental and queue state, in batch form over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators import ingest, writes
from gazette.plans.base import Query, table
from gazette.streaming import marks

CUT = "2024-01-16 00:00:00"
_CUT = f"timestamp '{CUT}'"


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    return e.where(F.col("ts") < F.lit(CUT).cast("timestamp")), e.where(F.col("ts") >= F.lit(CUT).cast("timestamp"))


def _posts(df: DataFrame) -> DataFrame:
    value = ingest.watermark_value(F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "generated"), F.lit(None).cast("string"))
    return df.select(F.col("event_type").alias("board"), "event_id", value.alias("value"))


def _marks(df: DataFrame) -> DataFrame:
    return _posts(df).where("value is not null").groupBy("board").agg(F.max("value").alias("mark"))


def t1_watermark(spark: SparkSession, d: str) -> DataFrame:
    """All posts held against the marks of the first half: what is new, and boards without numbers."""
    old, _ = _split(spark, d)
    return ingest.above_marks(_posts(table(spark, d, "events")), _marks(old), "board", "value").select("board", "event_id")


def t2_marks(spark: SparkSession, d: str) -> DataFrame:
    old, new = _split(spark, d)
    return ingest.advance_marks(_posts(new), _marks(old), "board", "value")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """The events as jobs: state by event type."""
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_key"), status.alias("status"), F.col("ts").alias("finished_at"), (F.col("event_id") % 5).alias("attempts"))


def t3_enqueue(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("job_key"))
    return ingest.enqueue(wanted, _jobs(spark, d))


def t4_cooldown(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("job_key"))
    return ingest.outside_cooldown(wanted, _jobs(spark, d), "job_key", F.lit("2024-01-20 12:00:00").cast("timestamp"), 86_400)


def f9_t5_claim(spark: SparkSession, d: str) -> DataFrame:
    """The 100 oldest claimable rows after the claim."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "view", "pending").otherwise("done").alias("status"),
        F.lit("transient").alias("error_code"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").alias("next_run_at"), F.col("ts").alias("started_at"),
    )
    return ingest.claim(rows, now, 100).select("id", "status", F.col("attempts").cast("long").alias("attempts"))


def t6_transitions(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    jobs = _jobs(spark, d).where("status = 'processing'").withColumn("available_at", F.col("finished_at"))
    return jobs.withColumns(ingest.after_failure(now, F.lit(3))).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("available_at").alias("last_available"))


def t7_f10_reclaim(spark: SparkSession, d: str) -> DataFrame:
    """All jobs; those begun over three hours ago and still processed are taken back."""
    now = F.lit("2024-01-18 12:00:00").cast("timestamp")
    jobs = _jobs(spark, d).withColumns({"started_at": F.col("finished_at"), "available_at": F.col("finished_at")})
    return ingest.reclaimed(jobs, now).select("id", "status", "available_at", "finished_at")


def t8_admin(spark: SparkSession, d: str) -> DataFrame:
    """A retry of one in three jobs, and an abandonment of one in four, each over all jobs."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    jobs = _jobs(spark, d).withColumns({"available_at": F.col("finished_at"), "last_error": F.lit("e")})
    again = ingest.retried(jobs, F.col("id") % 3 == 0, now).select("id", F.col("status").alias("retried"), F.col("outcome").alias("retry_outcome"), "last_error", "available_at")
    gone = ingest.abandoned(jobs, F.col("id") % 4 == 0, now).select("id", F.col("status").alias("abandoned"), F.col("outcome").alias("abandon_outcome"), "finished_at")
    return again.join(gone, "id")


def c19_retry(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "transient").when(F.col("event_type") == "view", "empty").when(F.col("event_type") == "click", "quota_exhausted").when(F.col("event_type") == "signup", "internal").otherwise("fatal")
    return table(spark, d, "events").select("event_id", ingest.retry_delay(code, F.col("event_id") % 5).cast("long").alias("minutes"))


def f6_eligible(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("checked_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    status = F.when(F.col("last_type").isin("error", "view"), "unsupported").otherwise("ok")
    return last.select("user_id", ingest.should_crawl(status, F.col("checked_at"), F.lit("2024-02-05 00:00:00").cast("timestamp")).alias("eligible"))


def f11_visible_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders visible to users of one nation: a semi join with the session's keys."""
    mine = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(mine, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def s20_d11_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Second half merged into the first by user and type; the first time seen is kept."""
    cols = ["user_id", "event_type", "ts", "first_seen", "event_id"]
    old, new = (x.withColumn("first_seen", F.col("ts")).select(*cols) for x in _split(spark, d))
    return writes.upsert(old, new, ["user_id", "event_type"], "ts", ["first_seen"]).select("user_id", "event_type", "event_id", "first_seen")


def s21_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")) for x in _split(spark, d))
    return writes.insert_absent(old, new, ["user_id", "event_type"])


def s22_replace_range(spark: SparkSession, d: str) -> DataFrame:
    """The days from 10 to 12 January replaced by the purchases of those days."""
    days = table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    within = F.col("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return writes.replace_range(days, days.where(within & (F.col("event_type") == "purchase")), within).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def s23_diff_replace(spark: SparkSession, d: str) -> DataFrame:
    """Latest type of each user before and after the cut, as actions."""
    old, new = (x.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind")) for x in _split(spark, d))
    return writes.diff_replace(old, new, ["user_id"], ["kind"])


def t10_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Triggers of each user at least an hour after the last accepted one."""
    return marks.debounce(table(spark, d, "events"), "user_id", "ts", 3600)


_POSTS = "select event_type as board, event_id, ts, case when event_type <> 'error' then event_id end as value from events"
_JOBS = "select event_id as id, user_id as job_key, case event_type when 'view' then 'queued' when 'click' then 'processing' when 'error' then 'failed' else 'completed' end as status, ts as finished_at, event_id % 5 as attempts from events"
QUERIES: dict[str, Query] = {
    "t1_f13_watermark": (t1_watermark, f"with p as ({_POSTS}), m as (select board, max(value) as mark from p where ts < {_CUT} and value is not null group by 1) select p.board, event_id from p left join m on p.board = m.board where value is null or mark is null or value > mark"),
    "t2_a4_u5_marks": (t2_marks, "select event_type as board, max(event_id) as mark from events where event_type <> 'error' group by 1"),
    "t3_j8_enqueue": (t3_enqueue, f"select c_custkey as job_key from customer where c_custkey not in (select job_key from ({_JOBS}) where status in ('queued', 'processing'))"),
    "t4_cooldown": (t4_cooldown, f"select c_custkey as job_key from customer where c_custkey not in (select job_key from ({_JOBS}) where status = 'completed' and finished_at > timestamp '2024-01-19 12:00:00')"),
    "f9_k2_t5_claim": (f9_t5_claim, "select event_id as id, 'processing' as status, event_id % 5 + 1 as attempts from events where event_type = 'view' or (event_type = 'error' and event_id % 5 < 3 and ts <= timestamp '2024-01-20 00:00:00') or (event_type = 'click' and ts < timestamp '2024-01-19 21:00:00') order by ts, event_id limit 100"),
    "t6_transitions": (t6_transitions, f"select case when attempts < 3 then 'queued' else 'failed' end as status, count(*) as n, max(case when attempts < 3 then timestamp '2024-02-01 00:02:00' else finished_at end) as last_available from ({_JOBS}) where status = 'processing' group by 1"),
    "t7_f10_reclaim": (t7_f10_reclaim, "select event_id as id, case when stale and event_id % 5 < 3 then 'queued' when stale then 'failed' else status end as status, case when stale and event_id % 5 < 3 then timestamp '2024-01-18 12:00:00' else ts end as available_at, case when stale and event_id % 5 >= 3 then timestamp '2024-01-18 12:00:00' else ts end as finished_at from (select *, event_type = 'click' and ts < timestamp '2024-01-18 09:00:00' as stale, case event_type when 'view' then 'queued' when 'click' then 'processing' when 'error' then 'failed' else 'completed' end as status from events)"),
    "t8_admin": (t8_admin, f"""with j as ({_JOBS}), a as (select distinct job_key from j where status in ('queued', 'processing')), r as (select j.*, case when id % 3 <> 0 then null when status <> 'failed' then 'not_failed' when a.job_key is not null then 'job_key_already_active' else 'queued' end as ro, case when id % 4 <> 0 then null when status in ('queued', 'processing') then 'failed' else 'not_active' end as ao from j left join a on j.job_key = a.job_key)
      select id, case when ro = 'queued' then 'queued' else status end as retried, ro as retry_outcome, case when ro is distinct from 'queued' then 'e' end as last_error, case when ro = 'queued' then timestamp '2024-02-01 00:00:00' else finished_at end as available_at, case when ao = 'failed' then 'failed' else status end as abandoned, ao as abandon_outcome, case when ao = 'failed' then timestamp '2024-02-01 00:00:00' else finished_at end as finished_at from r"""),
    "c19_retry": (c19_retry, "select event_id, case event_type when 'error' then 30 when 'view' then 360 when 'click' then 1440 when 'signup' then case when event_id % 5 < 3 then 360 end end::bigint as minutes from events"),
    "f6_eligible": (f6_eligible, "select user_id, last_type not in ('error', 'view') or checked_at <= timestamp '2024-01-29 00:00:00' as eligible from (select user_id, ts as checked_at, event_type as last_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"),
    "f11_j7_visible_rows": (f11_visible_rows, "select o_orderstatus, count(*) as n from orders where exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = 3) group by 1"),
    "s20_d11_upsert": (s20_d11_upsert, "select user_id, event_type, arg_max(event_id, ts) as event_id, min(ts) as first_seen from events group by 1, 2"),
    "s21_insert_absent": (s21_insert_absent, f"select user_id, event_type, coalesce(min(event_id) filter (where ts < {_CUT}), min(event_id)) as event_id from events group by 1, 2"),
    "s22_replace_range": (s22_replace_range, "select ts::date as day, count(*) as n from events where ts::date not between date '2024-01-10' and date '2024-01-12' or event_type = 'purchase' group by 1"),
    "s23_diff_replace": (s23_diff_replace, f"with o as (select user_id, arg_max(event_type, ts) as kind from events where ts < {_CUT} group by 1), n as (select user_id, arg_max(event_type, ts) as kind from events where ts >= {_CUT} group by 1) select coalesce(o.user_id, n.user_id) as user_id, n.kind, case when o.user_id is null then 'insert' when n.user_id is null then 'delete' when o.kind = n.kind then 'keep' else 'update' end as action from o full join n on o.user_id = n.user_id"),
    "t10_debounce": (t10_debounce, "with recursive a as (select user_id, min(ts) as ts from events group by 1 union all select e.user_id, min(e.ts) as ts from a join events e on e.user_id = a.user_id and e.ts >= a.ts + interval 1 hour group by 1) select user_id, ts from a"),
}
