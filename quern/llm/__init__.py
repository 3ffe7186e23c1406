"""Operators for large training-data pipelines; nothing else in quern imports this subpackage."""
