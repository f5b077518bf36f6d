"""Hierarchical, geographic and catalogue analytics as Spark plans."""
