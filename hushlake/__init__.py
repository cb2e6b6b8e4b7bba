"""Hushlake: privacy-observation analytics as Spark DataFrame jobs."""
