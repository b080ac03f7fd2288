"""Structured Streaming forms of the series operators."""
from tarnflow.streaming.weekly import new_faults, weekly_means

__all__ = ["new_faults", "weekly_means"]
