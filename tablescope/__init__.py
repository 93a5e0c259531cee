"""Automatic analytics for any table, written as Spark jobs."""
