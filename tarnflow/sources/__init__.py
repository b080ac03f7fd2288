"""Readers and writers."""
from tarnflow.sources.tables import read_table

__all__ = ["read_table"]
