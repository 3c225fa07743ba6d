"""Commerce reports, tolerant CSV ingestion and log-text jobs as Spark DataFrame functions."""
