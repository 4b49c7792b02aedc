"""Partitioned-graph motif analytics, expressed as Spark DataFrame plans."""
