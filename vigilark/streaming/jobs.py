"""Structured Streaming forms of the jobs.

State is bounded by watermarks. Sinks that write files from ``foreachBatch``
put each batch into its own folder, so a replayed batch overwrites itself and
nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilark import dims
from vigilark.operators import activity, deadletters, normalize, severity
from vigilark.plans.stages import canonical_rows, triaged_rows
from vigilark.sources import vector_store
from vigilark.sources.lines import stream_lines
from vigilark.streaming.versions import last_version, mark_version

LATE_AFTER = "4 hours"


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                once: bool = True) -> StreamingQuery:
    """Start ``handle`` on every micro-batch; ``once`` stops when the input is used up."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class CarriedActivity:
    """What earlier batches leave for the scores of later ones: sightings by hour, denied connections by second.

    Both are small tables below ``folder``, a version per batch, and hold only what a row within ``delay_s`` of
    the newest one can still ask for. They combine on the map side, so a hot address is one row an hour.
    """

    def __init__(self, folder: str, scan: dict, delay_s: int):
        self.folder, self.scan, self.delay_s = folder, scan, delay_s

    def read(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, DataFrame] | None:
        last = last_version(spark, self.folder, batch_id)
        return None if last is None else tuple(spark.read.parquet(f"{self.folder}/{name}/v{last}") for name in ("hours", "seconds"))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark, before = rows.sparkSession, self.read(rows.sparkSession, batch_id)
        hours, seconds = activity.hours_of(activity.sightings(rows)), activity.denied_seconds(rows)
        if before is not None:
            hours = activity.merged_hours(hours, before[0])
            seconds = seconds.unionByName(before[1]).groupBy("source_ip", "second").agg(F.sum("n").alias("n"))
        hours, seconds = hours.persist(), seconds.persist()
        newest = hours.agg(F.max(F.unix_micros("first.ts"))).first()[0] or 0
        oldest = newest // 1_000_000 - self.delay_s
        keep_hours = F.col("hour") >= oldest // 3600 - activity.ACTIVITY_HOURS
        newest_scan = seconds.agg(F.max("second")).first()[0] or 0
        keep_seconds = F.col("second") >= newest_scan - self.delay_s - self.scan["window_s"]
        hours.filter(keep_hours).write.mode("overwrite").parquet(f"{self.folder}/hours/v{batch_id}")
        seconds.filter(keep_seconds).write.mode("overwrite").parquet(f"{self.folder}/seconds/v{batch_id}")
        mark_version(spark, self.folder, batch_id)
        hours.unpersist()
        seconds.unpersist()


def ingest(spark: SparkSession, folder: str, archive: str, letters: str, checkpoint: str,
           max_files: int = 1000, once: bool = True, state: str | None = None, scan: dict | None = None,
           delay_s: int = 4 * 3600) -> StreamingQuery:
    """Lines to the archive (scored rows with their flags) and, where a normaliser failed, to the dead letters as well.

    Scores know of the rows of this and of earlier batches, as far as they are older in event time: address
    activity, and port scans with ``scan`` (window_s, threshold). ``state`` is the folder for what is carried
    over, beside the checkpoint by default. With files in the order of time the scores are those of
    :func:`triaged_rows` over all rows at once; a row later than ``delay_s`` may miss what is gone by then. What
    became of a batch's rows is counted on the way, below ``totals`` of the same folder.
    """
    scan = scan or {"window_s": dims.PORT_SCAN_WINDOW_S, "threshold": dims.PORT_SCAN_THRESHOLD}
    carried = CarriedActivity(state or f"{checkpoint.rstrip('/')}-activity", scan, delay_s)

    def store(batch: DataFrame, batch_id: int) -> None:
        # Computed once: a batch's uuids follow from its lines, but reading them is the larger part of the work.
        rows = canonical_rows(normalize.assign_uuids(batch), with_action=True).persist()
        before = carried.read(rows.sparkSession, batch_id) or (None, None)
        scored = triaged_rows(rows, scan=scan, carried_hours=before[0], carried_seconds=before[1])
        scored = scored.withColumn("event_date", F.to_date("event_timestamp")).persist()
        # Totals are observed on the way to the archive: no pass of their own.
        totals = Observation(f"outcome-{batch_id}")
        watched = scored.observe(totals, *(c.cast("bigint").alias(name) for name, c in severity.outcome_counts().items()))
        stored, _ = normalize.split_ingest(watched)
        _, bad = normalize.split_ingest(scored)
        (stored.write.mode("overwrite").partitionBy("event_date")
         .parquet(f"{archive}/batch_id={batch_id}"))
        bad.write.mode("overwrite").parquet(f"{letters}/batch_id={batch_id}")
        found = totals.get
        spark.createDataFrame([(n, v) for n, v in found.items()], "metric string, value bigint").coalesce(1).write.mode(
            "overwrite").parquet(f"{carried.folder}/totals/batch_id={batch_id}")
        carried.write(rows, batch_id)
        scored.unpersist()
        rows.unpersist()

    return run_batches(stream_lines(spark, folder, max_files), store, checkpoint, once)


def hourly_activity(rows: DataFrame) -> DataFrame:
    """Sightings per address and hour."""
    seen = rows.withWatermark("event_timestamp", LATE_AFTER).select(
        "event_timestamp", F.explode(F.filter(
            F.array("source_ip", "dest_ip"), lambda ip: F.length(ip) > 0)).alias("ip"))
    return seen.groupBy(F.window("event_timestamp", "1 hour").alias("w"), "ip").agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("hour_start"), "ip", "n")


def sliding_scans(rows: DataFrame, window: str = "90 seconds", slide: str = "10 seconds",
                  threshold: int = dims.PORT_SCAN_THRESHOLD, delay: str = "5 minutes") -> DataFrame:
    """Windows in which one source has too many denied connections."""
    denied = rows.filter(F.upper("action") == "DENY").withWatermark("event_timestamp", delay)
    return denied.groupBy(F.window("event_timestamp", window, slide).alias("w"), "source_ip").agg(
        F.count("*").alias("n")).filter(F.col("n") >= threshold).select(
        F.col("w.start").alias("window_start"), "source_ip", "n")


def sliding_bursts(rows: DataFrame, window: str = "60 seconds", slide: str = "10 seconds",
                   threshold: int = dims.BURST_THRESHOLD, delay: str = "5 minutes") -> DataFrame:
    """Windows in which one user, source and host has too many failed logins."""
    failed = rows.filter(F.col("event_type") == "AUTHENTICATION_FAILURE").withWatermark(
        "event_timestamp", delay)
    return failed.groupBy(
        F.window("event_timestamp", window, slide).alias("w"),
        "user_account", "source_ip", "hostname").agg(F.count("*").alias("n")).filter(
        F.col("n") >= threshold).select(
        F.col("w.end").alias("burst_time"), "user_account", "source_ip", "hostname", "n")


def host_sessions(rows: DataFrame, gap: str = "30 minutes", delay: str = LATE_AFTER) -> DataFrame:
    """Sessions per host with their first and last row, span, size and severity mix."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in dims.SEVERITIES]
    return (
        rows.withWatermark("event_timestamp", delay)
        .groupBy(F.session_window("event_timestamp", gap).alias("s"), "hostname")
        .agg(F.count("*").alias("n_events"), F.max("event_timestamp").alias("session_end"), *counts)
        .select("hostname", F.col("s.start").alias("session_start"), "session_end",
                F.round((F.unix_micros("session_end") - F.unix_micros("s.start")) / 60e6, 2).alias("span_minutes"),
                "n_events", *[f"n_{s.lower()}" for s in dims.SEVERITIES])
    )


def unique_rows(rows: DataFrame, delay: str = LATE_AFTER) -> DataFrame:
    """Each ``log_uuid`` once within the watermark."""
    return rows.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(["log_uuid"])


def burst_then_success(bursts: DataFrame, rows: DataFrame, within: str = "1 hour",
                       delay: str = "10 minutes") -> DataFrame:
    """Successful logins within an hour after a burst of the same user: stream-stream join.

    ``bursts`` holds (user_account, burst_time).
    """
    left = bursts.select(F.col("user_account").alias("burst_user"), "burst_time").withWatermark(
        "burst_time", delay)
    right = rows.filter(F.col("event_type") == "AUTHENTICATION_SUCCESS").select(
        "log_uuid", "user_account", "event_timestamp").withWatermark("event_timestamp", delay)
    near = (F.col("event_timestamp") >= F.col("burst_time")) & (
        F.col("event_timestamp") <= F.col("burst_time") + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col("burst_user") == F.col("user_account")) & near).select(
        "log_uuid", "user_account", "burst_time", "event_timestamp")


def alerts(rows: DataFrame) -> DataFrame:
    """P0 alert texts; stateless, so it runs on a stream as it is."""
    return severity.p0_alerts(rows)


def late_rows(folder: str, delay_s: int) -> Callable[[DataFrame, int], None]:
    """Batch handler that stores rows older than the newest earlier event time minus a delay.

    Each batch writes the newest event time up to itself as a one-row table, so only the last one is read.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = last_version(spark, folder, batch_id)
        newest = None if before is None else spark.read.parquet(f"{folder}/newest/v{before}").first().newest
        batch.agg(F.greatest(F.max("event_timestamp"), F.lit(newest).cast("timestamp")).alias("newest")).write.mode(
            "overwrite").parquet(f"{folder}/newest/v{batch_id}")
        late = batch.limit(0) if newest is None else batch.filter(
            F.unix_micros("event_timestamp") < F.unix_micros(F.lit(newest)) - delay_s * 1_000_000)
        late.write.mode("overwrite").parquet(f"{folder}/late/v{batch_id}")
        mark_version(spark, folder, batch_id)

    return split


def retry_letters(spark: SparkSession, source: str, target: str, queue: str, now: str) -> None:
    """One scheduled retry pass: resubmitted rows and the rewritten letter table.

    The rows go to a folder of the queue named after the pass, so a pass that is run again queues nothing twice.
    """
    letters = spark.read.parquet(source)
    again, after = deadletters.retry_pass(letters, F.lit(now).cast("timestamp"))
    name = "".join(c if c.isalnum() else "-" for c in now)
    again.write.mode("overwrite").parquet(f"{queue}/pass={name}")
    after.write.mode("overwrite").parquet(target)


def move_tiers(spark: SparkSession, active: str, archive: str, target: str, hot_s: int = dims.HOT_WINDOW_S,
               per_pass: int | None = None) -> None:
    """One scheduled tiering pass: rows older than ``hot_s`` before the newest move to the archive tier.

    The new tables are written below ``target`` (``active`` and ``archive``), so a pass that fails changes nothing.
    """
    rows = spark.read.parquet(active)
    newest = rows.agg(F.max("event_epoch").alias("m")).first().m
    if newest is None:
        newest = 0.0
    stay, cold = vector_store.migrate(rows, spark.read.parquet(archive), newest, hot_s, per_pass)
    stay.write.mode("overwrite").parquet(f"{target}/active")
    cold.write.mode("overwrite").parquet(f"{target}/archive")
