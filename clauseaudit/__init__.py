"""Auditing of procurement and specification documents as Spark jobs."""
