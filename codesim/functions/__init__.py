"""Part of the codesim engine."""
