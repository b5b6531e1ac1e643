"""The stages every entry point shares: lines to triaged rows, and rows to correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.dims import ThreatConfig
from vigilark.operators import activity, enrich, normalize, parse, severity


def canonical_rows(lines: DataFrame, ingested_at: Column | None = None, with_action: bool = False, **options) -> DataFrame:
    """(source_path, line) to canonical rows with sentence and hint.

    ``with_action`` keeps what a firewall line says it did (ALLOW, DENY), which the scan counter asks for.
    """
    identified = parse.identify_source(parse.parse_lines(lines))
    if with_action:
        identified = identified.withColumn("action", F.when(F.col("log_source") == "firewall", F.col("fields")["action"]))
        options["keep"] = (*options.get("keep", ("log_uuid", "source_path")), "action")
    rows = normalize.normalize(identified, ingested_at=ingested_at, **options)
    return enrich.enrich(rows)


def triaged_rows(rows: DataFrame, config: ThreatConfig | None = None, profile: str = "full",
                 with_activity: bool = True, scan: dict | None = None, carried_hours: DataFrame | None = None,
                 carried_seconds: DataFrame | None = None) -> DataFrame:
    """Canonical rows with queue severity and triage score.

    ``scan`` holds the window and threshold of the port-scan counter; without
    it (or without an ``action`` column) the counter reads as zero. ``carried_hours`` and
    ``carried_seconds`` hold what earlier rows leave for address activity and scans.
    """
    if with_activity:
        rows = rows.join(activity.ip_seen(rows, carried_hours), "log_uuid", "left")
        rows = rows.fillna(False, ["ip_seen"])
    options = {}
    if scan is not None and "action" in rows.columns:
        rows = activity.with_scan_count(rows, **scan, carried=carried_seconds)
        options["scan_threshold"] = scan["threshold"]
    return severity.triage_score(severity.queue_severity(rows), config, profile, **options)
