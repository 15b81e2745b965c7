"""Readers, file checks and the views that stand in for network tables."""
