"""Exact-match seeding and learned indexes over sequences, as Spark jobs."""
