"""Relational, incremental and retrieval operators."""
