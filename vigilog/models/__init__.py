"""Anomaly models fitted and applied as Spark jobs."""
