"""Registered queries, each beside the SQL that states it for another engine."""
