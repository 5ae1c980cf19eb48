"""Readers, writers and generators of vectors."""
