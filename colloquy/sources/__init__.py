"""Readers and the graph store."""
