"""Sources of the photo pipeline."""
