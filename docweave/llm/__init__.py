"""Operators of a training-data pipeline. Nothing else in docweave imports this subpackage."""
