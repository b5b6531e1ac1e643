"""Security-log analytics as Spark jobs: parse, normalise, enrich, score, correlate, report."""
