"""Receivables-portfolio analysis as plain Spark jobs."""
