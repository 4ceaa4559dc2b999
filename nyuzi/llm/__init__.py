"""Operators for training-data pipelines over text and audio. Nothing outside this package imports it."""
