"""Readers, stores and clients at the edges of the engine."""
