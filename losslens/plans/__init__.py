"""Queries by name, each a Spark plan and, where SQL can say it, the SQL of the same rows."""
