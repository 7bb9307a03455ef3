"""Clickstream events -> customer metrics -> customer segments, as Spark jobs."""
