"""Readers, writers and artifacts."""
