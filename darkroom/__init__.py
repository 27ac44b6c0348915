"""Photo-archive triage on Spark: metrics, verdicts, near-duplicates, reports and gallery queries."""
