"""Readers, writers and the mapping of a star schema to event tables."""
