"""Filters, options and configurations: what is to be computed, before any row is read."""
