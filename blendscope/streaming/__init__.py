"""Structured Streaming forms of the event segmentation."""
