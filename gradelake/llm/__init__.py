"""Operators of a training-data pipeline. Nothing else in gradelake imports this subpackage."""
