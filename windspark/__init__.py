"""Spark jobs for wind-turbine load studies at campaign scale."""
