"""Workload-balance analytics on Spark: telemetry, ranking, redistribution, shuffle metrics, topology."""
