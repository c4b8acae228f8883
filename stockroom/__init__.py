"""Stockroom: warehouse and stock analytics as Spark DataFrame jobs."""
