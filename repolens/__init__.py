"""repolens: Spark jobs for source-code intelligence over many repositories at once."""
