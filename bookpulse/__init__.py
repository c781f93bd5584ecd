"""Event-driven position book analytics as PySpark jobs."""
