"""Query catalogue built from the operators."""
