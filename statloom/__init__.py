"""Ratings and forecast analytics, and table operations around them, as Spark jobs."""
