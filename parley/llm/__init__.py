"""Operators for training-data pipelines at corpus scale; nothing else in the library imports them."""
