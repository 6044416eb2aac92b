"""Incremental intake and work-queue state as table transformations. One writer at a time; now is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermark_value(post_id: Column, method: Column, source: Column) -> Column:
    """The post's number where it may move a mark: not of generated posts or guessed ids."""
    fit = ~F.coalesce(method, F.lit("")).isin("generated", "file_download") & ~F.coalesce(source, F.lit("")).isin("path_numeric_segment", "href_query_id")
    return F.when(fit & post_id.rlike("^[0-9]{1,18}$"), post_id.cast("long"))


def above_marks(posts: DataFrame, marks: DataFrame, key: str, value: str) -> DataFrame:
    """Posts not seen yet: without a value, of a key without a mark, or above it. marks: key, mark."""
    return posts.join(marks.select(key, "mark"), key, "left").where(F.col(value).isNull() | F.col("mark").isNull() | (F.col(value) > F.col("mark"))).drop("mark")


def advance_marks(posts: DataFrame, marks: DataFrame, key: str, value: str) -> DataFrame:
    """The greater of the old mark and what was seen, for every key of either."""
    seen = posts.where(F.col(value).isNotNull()).select(key, F.col(value).alias("mark"))
    return marks.select(key, "mark").unionByName(seen).groupBy(key).agg(F.max("mark").alias("mark"))


def enqueue(requests: DataFrame, jobs: DataFrame, key: str = "job_key") -> DataFrame:
    """Requests whose key has no queued or running job."""
    return requests.join(jobs.where(F.col("status").isin("queued", "processing")).select(key).distinct(), key, "left_anti")


def outside_cooldown(requests: DataFrame, jobs: DataFrame, key: str, now: Column, seconds: int = 600) -> DataFrame:
    recent = jobs.where((F.col("status") == "completed") & (F.col("finished_at") > now - F.expr(f"interval {seconds} seconds"))).select(key).distinct()
    return requests.join(recent, key, "left_anti")


def claimable(now: Column, attempts: int = 3, stale_minutes: int = 180) -> Column:
    """Pending; failed but retryable and due; or processing for too long."""
    due = F.coalesce(F.col("next_run_at") <= now, F.lit(True))
    retry = (F.col("status") == "error") & ((F.col("error_code") == "quota_exhausted") | (F.col("attempts") < attempts)) & due
    return (F.col("status") == "pending") | retry | ((F.col("status") == "processing") & (F.col("started_at") < now - F.expr(f"interval {stale_minutes} minutes")))


def claim(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The n oldest claimable jobs as they are after the claim."""
    return jobs.where(claimable(now)).orderBy("created_at", "id").limit(max(n, 1)).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "started_at": now})


def after_failure(now: Column, max_attempts: Column, delay_seconds: int = 120) -> dict[str, Column]:
    """Columns of a job that failed: queued again after a delay while attempts are left."""
    again = F.col("attempts") < max_attempts
    return {"status": F.when(again, "queued").otherwise("failed"), "available_at": F.when(again, now + F.expr(f"interval {delay_seconds} seconds")).otherwise(F.col("available_at"))}


def retry_delay(code: Column, attempts: Column) -> Column:
    """Minutes to the next try; null when given up."""
    return F.when(code == "transient", 30).when(code == "empty", 360).when(code == "quota_exhausted", 1440).when((code == "internal") & (attempts < 3), 360)


def should_crawl(status: Column, checked_at: Column, now: Column, hours: int = 168, force: bool = False) -> Column:
    return F.lit(force) | (F.coalesce(status, F.lit("")) != "unsupported") | checked_at.isNull() | (checked_at <= now - F.expr(f"interval {hours} hours"))


#: States in which a first crawl is tried again.
TRY_AGAIN = ("pending", "internal_error", "fetch_timeout", "fetch_unavailable", "homepage_missing", "homepage_fetch_failed")


def needs_first_crawl(board_url: Column, checked_at: Column, status: Column) -> Column:
    """No board yet, and never checked or in a state to be tried again."""
    return (F.coalesce(board_url, F.lit("")) == "") & (checked_at.isNull() | F.coalesce(status, F.lit("pending")).isin(*TRY_AGAIN))


def should_probe(status: Column, known_board: Column, board: Column, checked_at: Column, now: Column, days: int = 30) -> Column:
    """Feeds of unknown state or of another board are probed, good ones not, unsupported ones after some days."""
    fresh = (F.coalesce(status, F.lit("")) != "") & F.coalesce(known_board == board, F.lit(False))
    return F.when(~fresh, True).when(status == "ok", False).when(status == "unsupported", F.coalesce(now - F.expr(f"interval {days} days") >= checked_at, F.lit(True))).otherwise(True)


def is_stale(status: Column, started_at: Column, now: Column, minutes: int = 180) -> Column:
    """Still being processed, long after it began."""
    return F.coalesce((status == "processing") & (started_at < now - F.expr(f"interval {minutes} minutes")), F.lit(False))


def reclaimed(jobs: DataFrame, now: Column, minutes: int = 180, max_attempts: int = 3) -> DataFrame:
    """Stale jobs queued again, at once, while attempts are left; else failed. Other jobs as they are."""
    stale, again = is_stale(F.col("status"), F.col("started_at"), now, minutes), F.col("attempts") < max_attempts
    return jobs.withColumns({
        "status": F.when(stale, F.when(again, "queued").otherwise("failed")).otherwise(F.col("status")),
        "available_at": F.when(stale & again, now).otherwise(F.col("available_at")), "finished_at": F.when(stale & ~again, now).otherwise(F.col("finished_at")),
    })


def retried(jobs: DataFrame, chosen: Column, now: Column, key: str = "job_key") -> DataFrame:
    """Chosen failed jobs queued at once without their error, unless a job of their key is queued or being processed; outcome says which."""
    active = jobs.where(F.col("status").isin("queued", "processing")).select(F.col(key).alias("_active")).distinct()
    met = jobs.join(active, F.col(key) == F.col("_active"), "left")
    outcome = F.when(~chosen, None).when(F.col("status") != "failed", "not_failed").when(F.col("_active").isNotNull(), "job_key_already_active").otherwise("queued")
    done = outcome == "queued"
    return met.withColumn("outcome", outcome).withColumns({"status": F.when(done, "queued").otherwise(F.col("status")), "available_at": F.when(done, now).otherwise(F.col("available_at")), "last_error": F.when(~F.coalesce(done, F.lit(False)), F.col("last_error"))}).drop("_active")


def abandoned(jobs: DataFrame, chosen: Column, now: Column) -> DataFrame:
    """Chosen jobs that are queued or being processed fail now; outcome says which of the chosen were not."""
    active = F.col("status").isin("queued", "processing")
    out = jobs.withColumn("outcome", F.when(~chosen, None).when(active, "failed").otherwise("not_active"))
    return out.withColumns({"status": F.when(chosen & active, "failed").otherwise(F.col("status")), "finished_at": F.when(chosen & active, now).otherwise(F.col("finished_at"))})
