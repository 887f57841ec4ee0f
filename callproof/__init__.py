"""Integrity checks of web-API call logs against a relational database, as Spark jobs."""
