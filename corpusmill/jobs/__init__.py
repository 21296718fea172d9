"""spark-submit entry points: rewrite, prepare, report."""
