"""Results analytics as Spark jobs: sheets, ingestion, catalogs, directories and progressions."""
