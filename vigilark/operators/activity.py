"""Counters over event time: address activity, scans, bursts, tunnels and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.detect import parent_domain, shannon_entropy
from vigilark.functions.timeblocks import epoch, latest_before, running_sum, sliding_count, sliding_sum

ACTIVITY_HOURS = 4


def sightings(rows: DataFrame) -> DataFrame:
    """One row per log row and distinct address, with how often the row names it."""
    pair = F.filter(F.array("source_ip", "dest_ip"), lambda ip: F.length(ip) > 0)
    times = F.when((F.size("_ips") == 2) & (F.get("_ips", 0) == F.get("_ips", 1)), 2).otherwise(1)
    return (
        rows.withColumn("_ips", pair)
        .select("log_uuid", F.col("event_timestamp").alias("ts"), times.alias("times"),
                F.explode(F.array_distinct("_ips")).alias("ip"))
        .withColumn("hour", F.floor(F.unix_micros("ts") / 3_600_000_000).cast("bigint"))
    )


def _earlier_hours(per_hour: DataFrame) -> DataFrame:
    """Add ``in_hours``: sightings in the three hours before; at most one row per hour and key."""
    frame = Window.partitionBy("ip").orderBy("hour").rangeBetween(-(ACTIVITY_HOURS - 1), -1)
    return per_hour.withColumn("in_hours", F.coalesce(F.sum("n").over(frame), F.lit(0)))


def ip_activity(rows: DataFrame) -> DataFrame:
    """Sightings of an address in this and the three earlier hour buckets, before this row.

    Order inside an hour is event time, then ``log_uuid``; a row never counts itself.
    """
    seen = sightings(rows)
    hours = _earlier_hours(seen.groupBy("ip", "hour").agg(F.sum("times").alias("n")))
    # A row that names the address twice moves the counter by two.
    summed = running_sum(seen, ["ip", "hour"], ["ts", "log_uuid"], F.col("times"), "upto")
    return summed.join(hours, ["ip", "hour"], "left").select(
        "log_uuid", "ip",
        (F.col("upto") - F.col("times") + F.col("in_hours")).alias("prior_count"))


def hours_of(seen: DataFrame) -> DataFrame:
    """(ip, hour, n, first): sightings of an address in an hour, and the first of them."""
    return seen.groupBy("ip", "hour").agg(F.sum("times").alias("n"), F.min(F.struct("ts", "log_uuid")).alias("first"))


def merged_hours(hours: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables of hours as one."""
    return hours.unionByName(more).groupBy("ip", "hour").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def sightings_seen(rows: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """(log_uuid, ip, seen): was this address of the row sighted before, within four hours?

    Only "at all" matters here, so each (address, hour) is reduced to its
    first sighting and its count before anything is joined back. ``carried``
    holds the hours of rows that came earlier.
    """
    seen = sightings(rows)
    hours = hours_of(seen)
    hours = _earlier_hours(hours if carried is None else merged_hours(hours, carried))
    return seen.join(hours, ["ip", "hour"]).select(
        "log_uuid", "ip",
        ((F.col("in_hours") > 0) | (F.struct("ts", "log_uuid") > F.col("first"))).alias("seen"))


def ip_seen(rows: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """(log_uuid, ip_seen): was the source or destination sighted before, within four hours?"""
    return sightings_seen(rows, carried).groupBy("log_uuid").agg(F.max("seen").alias("ip_seen"))


def denied_seconds(rows: DataFrame) -> DataFrame:
    """(source_ip, second, n): denied connections of an address in a second."""
    denied = rows.filter((F.upper("action") == "DENY") & (F.length("source_ip") > 0))
    return denied.groupBy("source_ip", epoch("event_timestamp").alias("second")).agg(F.count("*").alias("n"))


def port_scan_counts(rows: DataFrame, window_s: int = dims.PORT_SCAN_WINDOW_S,
                     carried: DataFrame | None = None) -> DataFrame:
    """(source_ip, second, n, n_in_window) over denied connections; ``carried`` holds seconds of earlier rows."""
    seconds = denied_seconds(rows)
    if carried is not None:
        seconds = seconds.unionByName(carried).groupBy("source_ip", "second").agg(F.sum("n").alias("n"))
    return sliding_sum(seconds, ["source_ip"], "second", window_s)


def port_scans(rows: DataFrame, window_s: int = dims.PORT_SCAN_WINDOW_S,
               threshold: int = dims.PORT_SCAN_THRESHOLD, carried: DataFrame | None = None) -> DataFrame:
    """Seconds at which a source reaches the scan threshold."""
    return port_scan_counts(rows, window_s, carried).filter(F.col("n_in_window") >= threshold)


def with_scan_count(rows: DataFrame, window_s: int = dims.PORT_SCAN_WINDOW_S,
                    threshold: int = dims.PORT_SCAN_THRESHOLD, carried: DataFrame | None = None) -> DataFrame:
    """Add ``scan_count``: the source's denied connections in the window at this second."""
    scans = port_scans(rows, window_s, threshold, carried).select(
        "source_ip", "second", F.col("n_in_window").alias("scan_count"))
    return (
        rows.withColumn("second", epoch("event_timestamp"))
        .join(scans, ["source_ip", "second"], "left")
        .withColumn("scan_count", F.coalesce("scan_count", F.lit(0))).drop("second")
    )


BURST_KEYS = ["user_account", "source_ip", "hostname"]


def auth_failures(rows: DataFrame, window_s: int = dims.BURST_WINDOW_S) -> DataFrame:
    """(user, source, host, second, n, n_in_window) over failed authentications."""
    failed = rows.filter(F.col("event_type") == "AUTHENTICATION_FAILURE").select(
        *BURST_KEYS, epoch("event_timestamp").alias("second"))
    return sliding_count(failed, BURST_KEYS, "second", window_s)


def auth_bursts(rows: DataFrame, window_s: int = dims.BURST_WINDOW_S,
                threshold: int = dims.BURST_THRESHOLD) -> DataFrame:
    """Failed authentications that belong to a burst, with the new event type and the count."""
    bursts = auth_failures(rows, window_s).filter(F.col("n_in_window") >= threshold).select(
        *BURST_KEYS, "second", F.col("n_in_window").alias("failure_count"))
    failed = rows.filter(F.col("event_type") == "AUTHENTICATION_FAILURE").withColumn(
        "second", epoch("event_timestamp"))
    # Missing users or hosts count as one key, in the count and in the join.
    left, right = failed.alias("l"), bursts.alias("r")
    same = F.lit(True)
    for key in [*BURST_KEYS, "second"]:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return (
        left.join(right, same).select("l.*", "r.failure_count").drop("second")
        .withColumn("event_type", F.lit("AUTHENTICATION_FAILURE_BURST"))
    )


def bruteforce_wins(rows: DataFrame, window_s: int = dims.BURST_WINDOW_S,
                    threshold: int = dims.BURST_THRESHOLD, within_s: int = 3600) -> DataFrame:
    """Successful logins with a failure burst of the same user shortly before."""
    bursts = auth_failures(rows, window_s).filter(F.col("n_in_window") >= threshold).select(
        "user_account", "second")
    wins = rows.filter(F.col("event_type") == "AUTHENTICATION_SUCCESS").select(
        "log_uuid", "user_account", "hostname", epoch("event_timestamp").alias("second"))
    matched = latest_before(wins, bursts, ["user_account"], "second", within_s)
    return wins.join(matched, ["user_account", "second"]).select(
        "log_uuid", "user_account", "hostname", "second",
        F.col("matched_second").alias("burst_second"))


def dns_tunnels(rows: DataFrame, window: str = "10 minutes", min_queries: int = 10,
                min_entropy: float = dims.DNS_ENTROPY_THRESHOLD) -> DataFrame:
    """Source and parent domain pairs with many high-entropy names in one window."""
    named = rows.filter(F.length("dns_query") > 0).select(
        "source_ip", "event_timestamp", parent_domain("dns_query").alias("parent"),
        shannon_entropy("dns_query").alias("entropy"))
    return (
        named.filter(F.col("entropy") > min_entropy)
        .groupBy("source_ip", "parent", F.window("event_timestamp", window).alias("w"))
        .agg(F.count("*").alias("n_queries"), F.avg("entropy").alias("avg_entropy"))
        .filter(F.col("n_queries") >= min_queries)
        .select("source_ip", "parent", F.col("w.start").alias("window_start"), "n_queries",
                "avg_entropy")
    )


def host_sessions(rows: DataFrame, gap_s: int = 1800, severity: str = "severity") -> DataFrame:
    """Activity sessions per host: a new one starts after more than ``gap_s`` of silence.

    Rows inside one gap-long slot always share a session, so a host is first
    reduced to one row per slot; the session logic then runs over slots.
    """
    slot = F.floor(F.unix_micros("event_timestamp") / (gap_s * 1_000_000))
    counts = {s: F.count_if(F.col(severity) == s) for s in dims.SEVERITIES}
    slots = rows.groupBy("hostname", slot.alias("slot")).agg(
        F.min("event_timestamp").alias("first_ts"), F.max("event_timestamp").alias("last_ts"),
        F.count("*").alias("n"), *[c.alias(f"n_{s.lower()}") for s, c in counts.items()])
    by_host = Window.partitionBy("hostname").orderBy("slot")
    silence = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(by_host))
    started = F.when(silence.isNull() | (silence > gap_s * 1_000_000), 1).otherwise(0)
    numbered = slots.withColumn("started", started).withColumn(
        "session_no", F.sum("started").over(by_host.rowsBetween(Window.unboundedPreceding, 0)))
    sums = [F.sum(f"n_{s.lower()}").alias(f"n_{s.lower()}") for s in dims.SEVERITIES]
    return (
        numbered.groupBy("hostname", "session_no")
        .agg(F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_end"),
             F.sum("n").alias("n_events"), *sums)
        .withColumn("span_minutes", F.round(
            (F.unix_micros("session_end") - F.unix_micros("session_start")) / 60e6, 2))
    )
