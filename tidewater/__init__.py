"""Panels of many time series, forecast evidence and text features as Spark jobs."""
