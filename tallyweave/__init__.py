"""Entity resolution and decision evidence as Spark jobs."""
