"""Playbill: event-listing analytics as Spark jobs."""
