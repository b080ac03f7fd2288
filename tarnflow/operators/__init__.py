"""Distributed operators: series, hierarchies, time matching, places, graphs, simulation."""
