"""Readers and writers for event logs, histories, sessions and lookup tables."""
