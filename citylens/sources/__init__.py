"""Readers for the city feeds; each returns a lazy DataFrame."""
