"""Certificate analytics for geographic prediction tables, as Spark jobs."""
