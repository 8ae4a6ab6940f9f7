"""Nightly runs: when they start, what they take, how they end, and what each has to report.

runs: id, run_date, trigger, status, window_start (null: since the beginning), started_at, finished_at, queued_new,
queued_failed, ... ; other frames as in review. Times are half-open; an open run ends at `now`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.review import first_of, live_mentions

# Fixed values.
TOP, FAILED_ITEMS, START_GRACE_MINUTES = 5, 10, 5


def window_starts(runs: DataFrame) -> DataFrame:
    """Adds window_start: the start of the last run before that didn't fail; null for the first."""
    before = Window.orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("window_start", F.max(F.when(F.col("status") != "failed", F.col("started_at"))).over(before))


def latest(runs: DataFrame, run_date: str | None = None) -> DataFrame:
    """The newest run, of one date if given."""
    rows = runs if run_date is None else runs.where(F.col("run_date") == F.to_date(F.lit(run_date)))
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def due(now: Column, zone: str, at: str, enabled: Column, ran_today: Column) -> Column:
    """Whether the local clock has reached `at` (HH:MM) and no scheduled run of the day exists; safe when clocks change."""
    hour, minute = map(int, at.split(":"))
    local = F.from_utc_timestamp(now, zone)
    return enabled & ~ran_today & (F.hour(local) * 60 + F.minute(local) >= hour * 60 + minute)


def local_date(now: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(now, zone))


def scheduled(runs: DataFrame) -> DataFrame:
    """Dates that have a scheduled run which didn't fail."""
    return runs.where("trigger = 'schedule' AND status <> 'failed'").select("run_date").distinct()


def start_outcomes(wishes: DataFrame, runs: DataFrame) -> DataFrame:
    """wish_id, outcome of wishes (wish_id, run_date, trigger): already_started, busy while a run is open, or started."""
    open_ = runs.where("status = 'running'").agg((F.count(F.lit(1)) > 0).alias("busy"))
    done = scheduled(runs).withColumn("done", F.lit(True))
    rows = wishes.join(done, "run_date", "left").join(F.broadcast(open_))
    outcome = F.when((F.col("trigger") == "schedule") & F.coalesce("done", F.lit(False)), "already_started").when(F.col("busy"), "busy").otherwise("started")
    return rows.select("wish_id", outcome.alias("outcome"))


def work_list(pending: DataFrame, failed: DataFrame, most: int) -> DataFrame:
    """id, class, place: pending revisions (id, created_at), oldest first, then failed ones, `most` at most."""
    rows = pending.select("id", "created_at", F.lit(0).alias("class")).unionByName(failed.select("id", "created_at", F.lit(1).alias("class")))
    cut = rows.orderBy("class", "created_at", "id").limit(most)
    return cut.withColumn("place", F.row_number().over(Window.orderBy("class", "created_at", "id"))).select("id", "class", "place")


def queue_counts(runs: DataFrame, work: DataFrame, run_id) -> DataFrame:
    """Runs with the numbers of queued revisions on the given one if it is still open; with nothing queued it is complete."""
    counts = work.agg(F.count_if(F.col("class") == 0).alias("__new"), F.count_if(F.col("class") == 1).alias("__failed"))
    own = (F.col("id") == run_id) & (F.col("status") == "running")
    out = runs.join(F.broadcast(counts)).withColumns({"queued_new": F.when(own, F.col("__new")).otherwise(F.col("queued_new")), "queued_failed": F.when(own, F.col("__failed")).otherwise(F.col("queued_failed"))})
    return out.withColumn("status", F.when(own & (F.col("__new") + F.col("__failed") == 0), "complete").otherwise(F.col("status"))).select(*runs.columns)


def close_open(runs: DataFrame, now: Column, waiting: Column, max_hours: int) -> DataFrame:
    """Runs with the open one closed if it is time.

    Without anything queued it has been interrupted once five minutes have passed. Otherwise it is complete when no work
    waits, or timed out after max_hours.
    """
    age = F.unix_micros(now) - F.unix_micros("started_at")
    empty, late = F.col("queued_new") + F.col("queued_failed") == 0, age > max_hours * 3_600_000_000
    running = F.col("status") == "running"
    dead = running & empty & (age >= START_GRACE_MINUTES * 60_000_000)
    done = running & ~empty & (late | (waiting == 0))
    known = {c: F.col(c) for c in runs.columns}
    change = {
        "status": F.when(dead, "failed").when(done, "complete").otherwise(F.col("status")), "finished_at": F.when(dead | done, now).otherwise(F.col("finished_at")),
        "timed_out": F.when(done, late).otherwise(known.get("timed_out", F.lit(False))), "error": F.when(dead, "start_interrupted").otherwise(known.get("error", F.lit(None).cast("string"))),
    }
    return runs.withColumns(change)


def bounds(runs: DataFrame, now: Column) -> DataFrame:
    return runs.select(F.col("id").alias("run_id"), "started_at", F.coalesce("finished_at", now).alias("out_end"), "window_start")


def by_hour(runs: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each hour that a run's window touches, so that a window meets its rows in an equi-join."""
    hour = lambda c: F.unix_timestamp(F.date_trunc("hour", c))
    return runs.withColumn("__hour", F.explode(F.sequence(hour(F.col(start)), hour(F.col(end)), F.lit(3600))))


def within(rows: DataFrame, runs: DataFrame, at: str, start: str = "started_at", end: str = "out_end") -> DataFrame:
    """Rows with each run whose [start, end) holds their time; windows are cut into hours, never a nested loop."""
    hour = F.unix_timestamp(F.date_trunc("hour", at))
    return rows.withColumn("__hour", hour).join(by_hour(runs, start, end), "__hour").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__hour")


def remaining(runs: DataFrame, entities: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """id, run_date, trigger, status, started_at and what each run left to review; links: review.visible_links."""
    r = bounds(runs, now).select("run_id", "started_at", "out_end")
    made = entities.where("status = 'proposed'").select("created_at").unionByName(links.select("created_at"))
    counts = within(made, r, "created_at").groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("remaining"))
    return runs.join(counts, "id", "left").select("id", "run_date", "trigger", "status", "started_at", F.coalesce("remaining", F.lit(0)).alias("remaining"))


def progress(runs: DataFrame, extractions: DataFrame, now: Column) -> DataFrame:
    """id and done: the revisions attempted in each run, at most those that it queued."""
    r = bounds(runs, now).select("run_id", "started_at", "out_end")
    tried = within(extractions.select("revision_id", "attempted_at"), r, "attempted_at").groupBy(F.col("run_id").alias("id")).agg(F.countDistinct("revision_id").alias("tried"))
    return runs.join(tried, "id", "left").select("id", F.least(F.coalesce("tried", F.lit(0)), F.col("queued_new") + F.col("queued_failed")).alias("done"))


class Digest(NamedTuple):
    summary: DataFrame  # run_id, done, entities, links, remaining, open_total, failed, created, changed, deleted, since_beginning
    by_type: DataFrame  # run_id, type, n
    top_entities: DataFrame  # run_id, place, id, name, type, confidence, source_title, source_path
    top_links: DataFrame  # run_id, place, id, kind, subject, relation, object, confidence
    failed: DataFrame  # run_id, place, path, error


def digest(runs: DataFrame, entities: DataFrame, edges: DataFrame, links: DataFrame, notes: DataFrame, revisions: DataFrame, extractions: DataFrame, now: Column) -> Digest:
    """The report of each run: what it made that awaits review, what failed in it, what was indexed before it."""
    r = bounds(runs, now)
    out = r.select("run_id", "started_at", "out_end")
    made = within(entities.where("status = 'proposed'").select("id", "name", "type", "created_at"), out, "created_at").drop("started_at", "out_end")
    by_type = made.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("n"))

    mentions = live_mentions(edges, notes, "title", "path")
    best = mentions.groupBy(F.col("dst_id").alias("id")).agg(F.max("confidence").alias("confidence"), F.min_by(F.struct("title", "path"), F.struct("created_at", "id")).alias("first"))
    top_entities = first_of(made.join(best, "id", "left"), ["run_id"], [F.desc_nulls_last("confidence"), F.col("name"), F.col("id")], TOP, "place").select(
        "run_id", "place", "id", "name", "type", "confidence", F.col("first.title").alias("source_title"), F.col("first.path").alias("source_path")
    )
    shown = within(links, out, "created_at").drop("started_at", "out_end")
    top_links = first_of(shown, ["run_id"], [F.desc("confidence"), F.col("created_at"), F.col("id")], TOP, "place").select(
        "run_id", "place", "id", F.when(F.col("src_type") == "entity", "relation").otherwise("mention").alias("kind"), "subject", "relation", "object", "confidence"
    )

    current = notes.where("deleted_at IS NULL AND current_revision_id IS NOT NULL").select(F.col("current_revision_id").alias("revision_id"), F.col("id").alias("note_id"), "path")
    worked = extractions.where("status = 'ok'").groupBy("revision_id").agg(F.max("attempted_at").alias("worked_at"))
    bad = extractions.where("status = 'failed'").join(current, "revision_id").join(worked, "revision_id", "left").where("worked_at IS NULL OR worked_at <= attempted_at")
    bad = first_of(within(bad.select("note_id", "path", "error", "attempted_at", "id"), out, "attempted_at"), ["run_id", "note_id"], [F.desc("attempted_at"), F.desc("id")])
    failed = first_of(bad, ["run_id"], [F.col("path")], FAILED_ITEMS, "place").select("run_id", "place", "path", "error")

    since = r.withColumn("from", F.coalesce("window_start", F.lit("1900-01-01").cast("timestamp"))).select("run_id", "from", "started_at")

    def indexed(rows: DataFrame, at: str, *columns: str) -> DataFrame:
        """Rows with each run whose input window holds their time: the windows of runs follow each other, few hold one time."""
        day = F.to_date(at)
        first = rows.agg(F.to_date(F.min(at)).alias("__first"))
        days = since.join(F.broadcast(first)).withColumn("__from", F.greatest(F.to_date("from"), F.col("__first"))).where("__from <= to_date(started_at)")
        days = days.withColumn("__day", F.explode(F.sequence("__from", F.to_date("started_at"))))
        return rows.withColumn("__day", day).join(days, "__day").where((F.col(at) >= F.col("from")) & (F.col(at) < F.col("started_at"))).select("run_id", *columns)

    created = indexed(notes.select("id", "created_at"), "created_at", "id")
    deleted = indexed(notes.where("deleted_at IS NOT NULL").select("id", "deleted_at"), "deleted_at", "id").groupBy("run_id").agg(F.count(F.lit(1)).alias("deleted"))
    again = revisions.withColumn("first", F.min("observed_at").over(Window.partitionBy("source_id"))).where("observed_at > first").select(F.col("source_id").alias("id"), "observed_at")
    changed = indexed(again, "observed_at", "id").distinct().join(created, ["run_id", "id"], "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("changed"))
    counts = {
        "entities": made.groupBy("run_id").agg(F.count(F.lit(1)).alias("entities")), "links": shown.groupBy("run_id").agg(F.count(F.lit(1)).alias("links")),
        "failed": bad.groupBy("run_id").agg(F.count(F.lit(1)).alias("failed")), "created": created.groupBy("run_id").agg(F.count(F.lit(1)).alias("created")), "changed": changed, "deleted": deleted,
    }
    waiting = entities.where("status = 'proposed'").agg(F.count(F.lit(1)).alias("a")).join(links.agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") + F.col("b")).alias("open_total"))
    summary = r.select("run_id", F.col("window_start").isNull().alias("since_beginning")).join(progress(runs, extractions, now).withColumnRenamed("id", "run_id"), "run_id")
    for name, frame in counts.items():
        summary = summary.join(frame, "run_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    summary = summary.withColumn("remaining", F.col("entities") + F.col("links")).join(F.broadcast(waiting))
    return Digest(summary, by_type, top_entities, top_links, failed)
