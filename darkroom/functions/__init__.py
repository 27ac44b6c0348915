"""Functions of the photo pipeline."""
