"""rowmill: ingest, sample, profile, clean, enrich, validate, reshape and aggregate records on Spark."""
