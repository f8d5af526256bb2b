"""tiersum: hierarchical-forecast reconciliation and corpus preparation as Spark jobs."""
