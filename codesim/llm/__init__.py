"""Operators for training-data pipelines. Nothing else in codesim imports this subpackage."""
