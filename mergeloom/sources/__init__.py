"""Readers and writers of the engine's own formats."""
