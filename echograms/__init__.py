"""Exact pattern mining over text tables, written as Spark DataFrame jobs."""
