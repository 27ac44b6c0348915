"""Streaming of the photo pipeline."""
