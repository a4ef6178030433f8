"""Sessionising, text and graph operators."""
