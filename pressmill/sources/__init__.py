"""Readers for landed inputs, and bindings of stored tables."""
