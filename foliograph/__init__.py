"""Document-structure and narration analytics, written as Spark DataFrame programs."""
