"""Recruitment event analytics as Spark plans: frequencies, life cycles, migration, profiles, routing and extraction."""
