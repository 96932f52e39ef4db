"""Sensitive-data detection, redaction and governance over Spark tables and streams."""
